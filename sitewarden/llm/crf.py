"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so the tokens of the training documents are labelled first: a word type is a cue when it stands
in many different contexts of toxic documents and in hardly any of clean ones (counting contexts, not occurrences, keeps
passages that are copied around from becoming cues). The chain has two states, emissions from the word and its prefix,
and four transitions; it is fitted by gradient steps on the exact likelihood. Forward and backward messages of two states
are one ratio each. A small logistic model turns the marginals of a document into its score.

Training takes at most `rows_per_class` documents of each class, the first by a hash of their id, and none longer than
`longest` characters; this bounds the driver's share at any input size. Scoring covers every whole text in one pass.

Null text counts as empty; an empty text has the score of a text without a toxic word. Repeated rows score alike. Labels
that are null are not used, a document with several labels counts as toxic when one says so. Without labels of both
classes the score is the share of toxic labels. Only the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.tables import parts, tidy, whole_numbers

ROWS_PER_CLASS, LONGEST = 1500, 20_000
#: A cue stands in at least this many contexts of toxic documents, and is this much more frequent there (log odds).
CUE_CONTEXTS, CUE_ODDS = 8, 2.5
#: Messages run over stretches of SPAN tokens with OVERLAP tokens on both sides; the chain forgets much faster.
SPAN, OVERLAP = 384, 48
ROWS = 512
STEPS, RATE, DECAY = 60, 0.25, 1e-3
KNOWN_WORDS = 200_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    transitions: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # 00 01 10 11
    document: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        word = word.lower()
        return self.bias + self.words.get(word, 0.0) + self.prefixes.get(word[:4], 0.0)


def messages(odds: np.ndarray, real: np.ndarray, transitions) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (state 1 to state 0) of chains in rows; odds: exp of the emissions; real: no padding."""
    a00, a01, a10, a11 = np.exp(transitions)
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    forward[:, 0] = odds[:, 0]
    for t in range(1, odds.shape[1]):
        r = forward[:, t - 1]
        forward[:, t] = odds[:, t] * (a01 + r * a11) / (a00 + r * a10)
    for t in range(odds.shape[1] - 2, -1, -1):
        s = odds[:, t + 1] * backward[:, t + 1]
        backward[:, t] = np.where(real[:, t + 1], (a10 + s * a11) / (a00 + s * a01), 1.0)
    return forward, backward


def expected(emissions: np.ndarray, lengths: np.ndarray, transitions) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token of chains that follow one another in `emissions`, and the expected number of each transition."""
    out, pairs = np.empty(len(emissions)), np.zeros(4)
    a00, a01, a10, a11 = np.exp(transitions)
    ends = np.cumsum(lengths)
    first, chain = [], []
    for start, end in zip(ends - lengths, ends, strict=True):
        at = np.arange(start, end, SPAN)
        first.append(at)
        chain.append(np.stack([np.full(len(at), start), np.full(len(at), end)], 1))
    if not first:
        return out, pairs
    first, chain = np.concatenate(first), np.concatenate(chain)
    width = SPAN + 2 * OVERLAP
    for k in range(0, len(first), ROWS):
        f, c = first[k : k + ROWS, None], chain[k : k + ROWS]
        low, high = np.maximum(f - OVERLAP, c[:, :1]), np.minimum(f + SPAN + OVERLAP, c[:, 1:])
        at = low + np.arange(min(width, int((high - low).max())))
        real = at < high
        odds = np.where(real, np.exp(np.clip(emissions[np.minimum(at, len(out) - 1)], -30, 30)), 1.0)
        forward, backward = messages(odds, real, transitions)
        both = forward * backward
        own = real & (at >= f) & (at < f + SPAN)
        out[at[own]] = (both / (1 + both))[own]
        r, q, counted = forward[:, :-1], (odds * backward)[:, 1:], own[:, :-1] & real[:, 1:]
        joint = [np.full_like(r, a00), a01 * q, a10 * r, a11 * r * q]
        total = sum(joint)
        pairs += [(j / total)[counted].sum() for j in joint]
    return out, pairs


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts one after the other as numbers, and how many each text has."""
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w.lower(), len(number)) for w in TOKEN.findall(t)], dtype=np.int64) for t in texts]
    return list(number), np.concatenate(rows), np.array([len(r) for r in rows])


def cues(word_at: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Which word types mark toxic documents, by the number of different contexts they stand in."""
    inner = np.ones(len(word_at), dtype=bool)
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # first words have nothing before them
    before = np.where(inner, np.roll(word_at, 1), -1) + 1
    after = np.where(np.roll(inner, -1), np.roll(word_at, -1), -1) + 1
    key = (word_at * (size + 1) + before) * (size + 1) + after
    of_toxic = np.repeat(toxic > 0, lengths)
    counts = [np.bincount(np.unique(key[m]) // (size + 1) ** 2, minlength=size) for m in (of_toxic, ~of_toxic)]
    odds = [np.log((c + 0.5) / (c.sum() + 1)) for c in counts]
    return (counts[0] >= CUE_CONTEXTS) & (odds[0] - odds[1] >= CUE_ODDS)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per chain: 1, log of the expected number of toxic tokens, highest marginal, expected share."""
    ends = np.cumsum(lengths)
    total = np.concatenate([[0.0], np.cumsum(p)])
    count = np.maximum(total[ends] - total[ends - lengths], 0)
    top = np.array([p[e - n : e].max() if n else 0.0 for e, n in zip(ends, lengths, strict=True)])
    return np.stack([np.ones(len(lengths)), np.log1p(count), top, np.sqrt(count / np.maximum(lengths, 1))], 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """The chain from a bounded list of documents; weight restores the share of the classes in the score."""
    model = Model()
    if not toxic.any() or toxic.all():
        share = (float((weight * toxic).sum()) + 0.5) / (float(weight.sum()) + 1) if len(toxic) else 0.0
        model.document = (math.log(share / (1 - share)) if share else -30.0, 0.0, 0.0, 0.0)
        return model
    words, word_at, lengths = numbered(texts)
    if not len(word_at):
        return fit([], toxic[:0], weight[:0])
    label = cues(word_at, lengths, toxic, len(words))[word_at] * np.repeat(toxic, lengths)
    number: dict[str, int] = {}
    prefix_at = np.array([number.setdefault(w[:4], len(number)) for w in words])[word_at]
    prefixes = list(number)
    # Gradient per feature, scaled by how often it occurs; a chain end cuts the transitions.
    last = np.zeros(len(word_at), dtype=bool)
    last[np.cumsum(lengths[lengths > 0]) - 1] = True
    inner = ~last[:-1]
    word_w, prefix_w, bias, trans = np.zeros(len(words)), np.zeros(len(prefixes)), -2.0, np.zeros(4)
    word_n, prefix_n = np.bincount(word_at) + 4.0, np.bincount(prefix_at) + 4.0
    seen = np.bincount((2 * label[:-1] + label[1:])[inner].astype(int), minlength=4)
    for _ in range(STEPS):
        p, pairs = expected(bias + word_w[word_at] + prefix_w[prefix_at], lengths, trans)
        off = label - p
        word_w += 8 * RATE * np.bincount(word_at, off, len(words)) / word_n * 4 - DECAY * word_w
        prefix_w += RATE * np.bincount(prefix_at, off, len(prefixes)) / prefix_n - 4 * DECAY * prefix_w
        bias += RATE * off.mean() * 10
        trans += RATE * (seen - pairs) / max(1.0, seen[1] + seen[3]) * 0.2 - DECAY * trans
    common = np.abs(word_w) > 0.05
    model.words = {words[i]: float(word_w[i]) for i in np.flatnonzero(common)}
    common = np.abs(prefix_w) > 0.02
    model.prefixes = {prefixes[i]: float(prefix_w[i]) for i in np.flatnonzero(common)}
    model.bias, model.transitions = float(bias), tuple(trans.tolist())
    emissions = np.array([model.emission(w) for w in words])[word_at]
    model.document = tuple(logistic(summary(expected(emissions, lengths, trans)[0], lengths), toxic, weight).tolist())
    return model


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, longest: int = LONGEST) -> Model:
    """Fit on a bounded sample of the labelled rows (doc_id, toxic) given."""
    spark = docs.sparkSession
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # Drawn from the rows that can be used, so long documents are replaced by others of their class.
    usable = marks.join(docs.where(F.length("text") <= longest).select("doc_id"), "doc_id", "left_semi")
    chosen = [r for y in (0, 1) for r in usable.where(F.col("toxic") == y).orderBy(*order).limit(rows_per_class).collect()]
    # Bounded: at most 2 * rows_per_class ids.
    sample = F.broadcast(whole_numbers(spark, [tuple(r) for r in chosen], "doc_id long, toxic int"))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").where(F.length("text") <= longest)
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).collect()
    rows = sorted({r["text"]: r for r in sorted(rows, key=lambda r: r["doc_id"])}.values(), key=lambda r: r["doc_id"])
    toxic = np.array([r["toxic"] for r in rows], dtype=float)
    each = {y: totals.get(y, 0) / max(1, int((toxic == y).sum())) for y in (0, 1)}
    return fit([r["text"] for r in rows], toxic, np.array([each[int(y)] for y in toxic]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def emissions(self, words: list[str]) -> list[float]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > KNOWN_WORDS:
                known.clear()
            distinct = set(words)
            known.update((w, self.model.emission(w)) for w in distinct if w not in known)
            return [known[w] for w in words]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of documents and their spans of tokens that are toxic more likely than not."""
        rows = [np.array(self.emissions(TOKEN.findall(t)), dtype=np.float64) for t in texts]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        p, _ = expected(np.concatenate(rows) if rows else np.empty(0), lengths, self.model.transitions)
        scores = 1 / (1 + np.exp(-np.clip(summary(p, lengths) @ np.array(self.model.document), -30, 30)))
        spans, ends = [], np.cumsum(lengths)
        for text, end, n in zip(texts, ends, lengths, strict=True):
            own = p[end - n : end]
            hits = set(np.flatnonzero(own >= 0.5).tolist())
            places = ((i, m) for i, m in enumerate(TOKEN.finditer(text)) if i in hits) if hits else ()
            spans.append([{"start": m.start(), "end": m.end(), "probability": float(own[i])} for i, m in places])
        return scores, spans


def score(docs: DataFrame, model: Model, text: str = "text", scored: str = "score", spans: str = "toxic_spans") -> DataFrame:
    """`docs` with the score of each text and its toxic spans (code points, end exclusive); no shuffle."""
    kept = [c for c in docs.columns if c not in (scored, spans)]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in parts(batches):
            scores, found = scorer([t or "" for t in part.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], [*part.schema.names, scored, spans])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{schema}, `{scored}` double, `{spans}` array<struct<start: bigint, end: bigint, probability: double>>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
