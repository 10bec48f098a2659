"""Quality of documents by a linear-chain conditional random field over their lines.

A line is described by what it is made of: shares of letters, capitals, digits, punctuation and other signs, its length,
the length of its words, how many of them are distinct, repeat the word before or end in a sign, and whether the line
stands in the document again. A line is labelled good or bad from its own features and those of the lines before and behind
it, and from the label of its neighbour: two states, four transitions, fitted by gradient steps on the exact likelihood.
Forward and backward messages give the probability of each line being bad; weighted by the lengths of the lines they are
the document's share of bad text, and a logistic model of that share is the score.

Labels are per document. All lines of a good document are good. Those of a bad one are judged alone first, by a logistic
model of their own features: lines that look good, as passages that good documents hold too, are taken for good, as long
as one stays bad. The chain learns these labels.

Training takes at most `rows_per_class` documents of each class, the first by a hash of their id, and of each one stretch
of at most `stretch` characters, which begins at a place given by the same hash; this bounds the driver's share at any
input size. Scoring covers every whole text in one pass without a shuffle.

Null text counts as empty; a text without any line that holds something has the score of the share of good documents among
such texts, drawn to that of all. Blank lines are no lines. Repeated rows score alike. Null labels are not used; a document
with several labels counts as bad when one says so. With labels of one class only the score is that class's share. Only the
text enters a score.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.crf import expected, logistic

ROWS_PER_CLASS, STRETCH = 1500, 20_000
STEPS, RATE, RIDGE = 80, 0.6, 1e-3
#: Texts are looked at in parts of about this many characters, cut at line ends.
PART = 1 << 19
LETTER, CAPITAL, DIGIT, BLANK, STOP, SIGN, END = range(7)
STOPS = ".,;:!?'\"()-’“”«»¿¡…–—"
NAMES = [
    "letters", "capitals", "digits", "stops", "signs", "log_chars", "log_words", "word_length", "distinct", "repeats",
    "signed_words", "lone_signs", "many_stops", "capital_words", "again",
]
SIZE = len(NAMES)


def classes() -> np.ndarray:
    """The class of every character of the first plane; characters beyond it count as signs."""
    kinds = np.full(0x10000, SIGN, dtype=np.int8)
    for code in range(0x10000):
        kind = unicodedata.category(chr(code))
        if kind in ("Lu", "Lt"):
            kinds[code] = CAPITAL
        elif kind[0] in "LM":
            kinds[code] = LETTER
        elif kind == "Nd":
            kinds[code] = DIGIT
        elif kind[0] == "Z" or kind == "Cc":
            kinds[code] = BLANK
    for c in STOPS:
        kinds[ord(c)] = STOP
    kinds[ord("\n")] = END
    return kinds


class Lines:
    """Features of the lines of texts."""

    def __init__(self):
        self.kinds = classes()
        self.mix = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)

    def part(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, characters, number) of each line; blank lines have 0 characters; `again` is still open."""
        code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        kind = self.kinds[np.minimum(code, 0xFFFF)]
        kind[code >= 0x10000] = SIGN
        line_of = np.cumsum(kind == END) - (kind == END)
        n_lines = int(np.count_nonzero(kind == END)) + 1
        count = np.bincount(line_of * 7 + kind, minlength=7 * n_lines).reshape(-1, 7).T.astype(float)
        inside = (kind != BLANK) & (kind != END)
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        first = np.flatnonzero(begins)
        if not len(first):
            return np.zeros((n_lines, SIZE)), np.zeros(n_lines), np.zeros(n_lines, dtype=np.uint64)
        length, line = np.flatnonzero(ends) - first + 1, line_of[first]
        per_word = lambda mask: np.add.reduceat(mask.astype(np.int32), first)
        # A number per word from its characters and their places, and one per line from its words and theirs.
        places = np.arange(len(code))
        at = places - np.maximum.accumulate(np.where(begins, places, 0))
        with np.errstate(over="ignore"):
            value = (code + np.uint64(1)) * self.mix[at & 63] ^ (at >> 6).astype(np.uint64)
            value ^= value >> np.uint64(29)
            word = np.add.reduceat(np.where(inside, value, np.uint64(0)), first) * self.mix[0]
            word ^= word >> np.uint64(32)
            order = np.arange(len(first)) - np.searchsorted(line, line)
            whole = np.zeros(n_lines, dtype=np.uint64)
            np.add.at(whole, line, word * self.mix[order & 63] + (order >> 6).astype(np.uint64))
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (line[1:] == line[:-1])])
        by_line = np.lexsort((word, line))
        fresh = np.concatenate([[True], (np.diff(word[by_line]) != 0) | (np.diff(line[by_line]) != 0)])
        distinct = np.bincount(line[by_line][fresh], minlength=n_lines)
        signs, stops, capitals = per_word(kind == SIGN), per_word(kind == STOP), per_word(kind == CAPITAL)
        letters = per_word(kind == LETTER) + capitals
        words = np.bincount(line, minlength=n_lines).astype(float)
        chars = count.sum(axis=0) - count[END] - count[BLANK]
        safe, w = np.maximum(chars, 1), np.maximum(words, 1)
        share = lambda mask: np.bincount(line[mask], minlength=n_lines) / w
        rows = np.stack([
            (count[LETTER] + count[CAPITAL]) / safe,
            count[CAPITAL] / np.maximum(count[LETTER] + count[CAPITAL], 1),
            count[DIGIT] / safe,
            count[STOP] / safe,
            count[SIGN] / safe,
            np.log1p(chars),
            np.log1p(words),
            np.minimum(np.bincount(line, length, n_lines) / w, 40) / 10,
            # Long lines repeat words anyway, so their share of distinct words is taken against its usual fall.
            distinct / w * np.sqrt(np.maximum(words, 30) / 30),
            share(same),
            share((signs > 0) & (letters > 0)),
            share((signs > 0) & (letters == 0)),
            share(stops > 1),
            share((capitals == letters) & (letters > 1)),
            np.zeros(n_lines),
        ], 1)
        return rows, chars, whole

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and characters of the lines that are not blank, texts one after the other, and how many each text has."""
        held: list[tuple[int, str]] = []
        made: list[tuple] = []

        def flush() -> None:
            of = np.repeat([n for n, _ in held], [t.count("\n") + 1 for _, t in held])
            rows, chars, whole = self.part("\n".join(t for _, t in held))
            real = chars > 0
            made.append((rows[real], chars[real], whole[real], of[real]))
            held.clear()

        room = PART
        for n, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text) if len(text) - at <= PART else text.find("\n", at + PART) + 1 or len(text)
                held.append((n, text[at:end]))
                room -= end - at
                at = end
                if room <= 0:
                    flush()
                    room = PART
        if held:
            flush()
        if not made:
            return np.zeros((0, SIZE)), np.zeros(0), np.zeros(len(texts), dtype=np.int64)
        rows, chars, whole, of = (np.concatenate(c) for c in zip(*made, strict=True))
        if len(rows):
            order = np.lexsort((whole, of))
            equal = (np.diff(whole[order]) == 0) & (np.diff(of[order]) == 0)
            rows[order[1:][equal], -1] = rows[order[:-1][equal], -1] = 1
        return rows, chars, np.bincount(of, minlength=len(texts))


def with_neighbours(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and of the line behind (zeros at an end), whether it is the first or last, 1."""
    ends = np.cumsum(lengths)
    held = lengths > 0
    first, last = np.zeros(len(rows)), np.zeros(len(rows))
    first[(ends - lengths)[held]] = 1
    last[ends[held] - 1] = 1
    before, behind = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], behind[:-1] = rows[:-1], rows[1:]
    before[first > 0], behind[last > 0] = 0, 0
    return np.concatenate([rows, before, behind, np.stack([first, last, np.ones(len(rows))], 1)], 1)


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(SIZE))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * SIZE + 3))
    transitions: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # good-good, good-bad, bad-good, bad-bad
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    empty: float = 0.5

    def bad(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(bad) of lines, given as the lines of all documents one after the other."""
        x = with_neighbours((rows - self.mean) / self.scale, lengths)
        return expected(x @ self.weights, lengths, self.transitions)[0]


def shares(p: np.ndarray, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Share of bad text of each document, weighted by the lengths of its lines; 0 without lines.

    Rounded, so that equal texts score alike whatever stands before them in a batch.
    """
    ends = np.cumsum(lengths)
    total = lambda v: (s := np.concatenate([[0.0], np.cumsum(v)]))[ends] - s[ends - lengths]
    return np.clip(np.round(total(p * chars) / np.maximum(total(chars), 1), 9), 0, 1)


def summary(share: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(share)), share, np.sqrt(share)], 1)


def chain(model: Model, rows: np.ndarray, lengths: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
    """Fit weights and transitions: gradient steps on the likelihood of the labels, each step scaled by its history."""
    x = with_neighbours((rows - model.mean) / model.scale, lengths)
    last = np.zeros(len(rows), dtype=bool)
    last[np.cumsum(lengths[lengths > 0]) - 1] = True
    seen = np.bincount((2 * label[:-1] + label[1:])[~last[:-1]].astype(int), minlength=4)
    w, t = np.zeros(x.shape[1]), np.zeros(4)
    past = np.zeros(len(w) + 4)
    for _ in range(STEPS):
        p, pairs = expected(np.clip(x @ w, -30, 30), lengths, t)
        gradient = np.concatenate([x.T @ (weight * (label - p)) / weight.sum() - RIDGE * w, (seen - pairs) / max(1, len(rows)) - RIDGE * t])
        past = 0.9 * past + 0.1 * gradient**2
        step = 0.1 * RATE * gradient / (np.sqrt(past) + 1e-6)
        w, t = w + step[:-4], t + step[-4:]
    model.weights, model.transitions = w, tuple(t.tolist())


def fit(texts: list[str], good: np.ndarray, weight: np.ndarray) -> Model:
    """The chain from a bounded list of texts; weight restores the share of the classes in the score."""
    model, lines = Model(), Lines()
    by_size = sorted(range(len(texts)), key=lambda n: texts[n].count("\n"))  # chains of like length are handled together
    texts, good, weight = [texts[n] for n in by_size], good[by_size], weight[by_size]
    share = (float((weight * good).sum()) + 1) / (float(weight.sum()) + 2)
    model.empty = share
    model.document = np.array([np.log(share / (1 - share)), 0.0, 0.0])
    rows, chars, lengths = lines(texts)
    hollow = lengths == 0
    model.empty = float(((weight * good)[hollow].sum() + 20 * share) / (weight[hollow].sum() + 20))
    if not good.any() or good.all() or not len(rows):
        return model
    model.mean, model.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
    of = np.repeat(np.arange(len(texts)), lengths)
    bad_text = good[of] == 0
    label = bad_text.astype(float)
    # Both classes weigh alike in the chain; the logistic model of documents below restores their shares.
    even = lambda: np.where(label > 0, 0.5 / max(1.0, label.sum()), 0.5 / max(1.0, (1 - label).sum())) * len(rows)
    alone = np.concatenate([(rows - model.mean) / model.scale, np.ones((len(rows), 1))], 1)
    p = alone @ logistic(alone, label, even())
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, of, p)
    label = (bad_text & ((p >= 0) | (p == top[of]))).astype(float)
    chain(model, rows, lengths, label, even())
    x = summary(shares(model.bad(rows, lengths), chars, lengths))
    model.document = logistic(x[~hollow], good[~hollow].astype(float), weight[~hollow])
    return model


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, stretch: int = STRETCH) -> Model:
    """Fit on a bounded sample of the labelled rows (doc_id, quality) given."""
    spark = docs.sparkSession
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    marks = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    totals = {r["good"]: r["n"] for r in marks.groupBy("good").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for y in (0, 1) for r in marks.where(F.col("good") == y).orderBy(*order).limit(rows_per_class).collect()]
    # Bounded: at most 2 * rows_per_class ids.
    sample = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, good int"))
    text = F.coalesce("text", F.lit(""))
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - stretch, F.lit(0)) + 1).cast("int") + 1
    part = F.when(F.length(text) <= stretch, text).otherwise(F.substring(text, begin, F.lit(stretch)))
    rows = docs.select("doc_id", part.alias("text")).join(sample, "doc_id").groupBy("doc_id", "good").agg(F.max("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    good = np.array([r["good"] for r in rows], dtype=int)
    each = {y: totals.get(y, 0) / max(1, int((good == y).sum())) for y in (0, 1)}
    return fit([r["text"] for r in rows], good, np.array([each[y] for y in good.tolist()], dtype=float))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lines = model, Lines()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[float]]]:
        """Scores of documents, and for each of their lines that are not blank the probability of being good."""
        rows, chars, lengths = self.lines(texts)
        p = self.model.bad(rows, lengths)
        scores = 1 / (1 + np.exp(-np.clip(summary(shares(p, chars, lengths)) @ self.model.document, -30, 30)))
        ends = np.cumsum(lengths)
        return np.where(lengths > 0, scores, self.model.empty), [(1 - p[e - n : e]).tolist() for e, n in zip(ends, lengths, strict=True)]


def score(docs: DataFrame, model: Model, text: str = "text", scored: str = "score", lines: str = "good_lines") -> DataFrame:
    """`docs` with the score of each text and the probabilities of its lines; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in (scored, lines)]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                scores, found = scorer([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.float64()))], [*part.schema.names, scored, lines])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{scored}` double, `{lines}` array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2
