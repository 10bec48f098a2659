"""Cross-entropy difference of a target and a background language model.

Both models are bigram models of one vocabulary, built and smoothed alike: the background from all texts, the target from
the chosen ones. The probability of a word after another is interpolated,
`(1 - backoff) * count(pair) / count(first) + backoff * (count(word) + 1) / (total + vocabulary)`. The score of a document
is its loss per token under the target minus that under the background; low scores read like the target.

All words of the texts are known. Documents are read in blocks of bounded size; a block numbers its own words. Pairs and
words are counted by a 64-bit hash. Each block sends the sorted keys and counts it has, cut into ranges of keys; a range adds
up what all blocks sent and answers each with the sums in the order it asked for; and each block scores its documents.
Ranges are as many as the tokens ask for. Words and pairs grow with the corpus and are never collected; of keys and counts
only packed differences travel.
`vocabulary` (off unless given) keeps that many words, the most frequent ones; all others, and words of more than
`LONGEST_WORD` bytes, are then one unknown word.

Null and empty texts have no tokens; their score and losses are 0. Repeated rows are counted and scored each. A target
without documents has the smoothed model of no counts. Empty tables give no rows; other columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.llm.tables import run_folder, saved

LONGEST_WORD, BACKOFF = 64, 0.3
#: A block ends with the document that brings it to this many tokens.
BLOCK_TOKENS = 1_500_000
START, UNKNOWN = 0, 1  # hashes of the word before the first one and of the unknown word

BLOCKS = "block bigint, keys array<bigint>, lengths array<bigint>, words array<bigint>, ids binary"
#: What is counted of each key: in all texts and in the chosen ones, and how often as the last word of those.
COUNTS = 4


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def vocabulary_of(docs: DataFrame, text: str, size: int) -> list[str]:
    """The most frequent words, ties by the word; counts cover all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.update(words_of(value or ""))
                if len(held) > 500_000:  # partial sums of a task stay bounded
                    yield out()
                    held.clear()
        yield out()

    counts = docs.select(text).mapInArrow(run, "word string, n bigint").where(F.octet_length("word") <= LONGEST_WORD)
    # Bounded: `size` words of at most LONGEST_WORD bytes.
    return [r["word"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of the same length and of any integer type, byte by byte and compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(blob: bytes, size: int, *kinds: str) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(pa.decompress(blob, size * sum(widths), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum([0, *widths]) * size
    return [np.ascontiguousarray(data[a:b].reshape(w, size).T).view(k).ravel() for a, b, w, k in zip(ends, ends[1:], widths, kinds, strict=False)]


def blocks(docs: DataFrame, vocabulary: list[str] | None, block_tokens: int) -> DataFrame:
    """`docs` (row, text) as blocks: hashes of the distinct words, and the words of all texts as places there.

    Place 0 is START. Texts are not shuffled.
    """
    held = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(set(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = TaskContext.get().partitionId(), [f.split()[0] for f in BLOCKS.split(", ")]
        rows: list[tuple[int, np.ndarray]] = []
        place: dict[str, int] = {}
        total, block = 0, 0

        def whole() -> pa.RecordBatch:
            known = [word_hash(w) if held is None or w in held.value else UNKNOWN for w in place]
            values = [
                [task << 32 | block], [[r[0] for r in rows]], [[len(r[1]) for r in rows]], [[START, *known]],
                [packed(np.concatenate([r[1] for r in rows]))],
            ]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for row, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = np.array([place.setdefault(w, len(place) + 1) for w in words_of(text or "")], dtype="<i4")
                rows.append((row, ids))
                total += len(ids)
                if total >= block_tokens or len(rows) >= block_tokens // 10:
                    yield whole()
                    rows, total, block = [], 0, block + 1
                    place.clear()
        if rows:
            yield whole()

    return docs.select("row", "text").mapInArrow(run, BLOCKS)


def _mixed(first: np.ndarray, second: np.ndarray | int) -> np.ndarray:
    """64-bit keys of two hashes each, the order of which counts."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(second, dtype=np.int64).view(np.uint64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Block:
    """The distinct pairs and words of a block, in the order of their keys, and how often it has them."""

    def __init__(self, row: dict):
        self.keys, self.lengths = row["keys"].values, row["lengths"].values
        lengths = self.lengths.to_numpy()
        # Words that the vocabulary takes for one are one here as well.
        words, own = np.unique(row["words"].values.to_numpy(), return_inverse=True)
        ids = own[unpacked(row["ids"].as_py(), lengths.sum(), "<i4")[0]].astype(np.int64)
        self.ends, some = np.cumsum(lengths), lengths > 0
        firsts = np.empty_like(ids)
        firsts[1:] = ids[:-1]
        firsts[(self.ends - lengths)[some]] = own[0]
        chosen = np.zeros(len(lengths), dtype=bool)
        chosen[np.array(row["chosen"].as_py() or [], dtype=np.int64)] = True
        marks, lasts = np.repeat(chosen, lengths), ids[self.ends[some] - 1]
        pairs, self.at = np.unique(firsts << 32 | ids, return_inverse=True)
        self.first, self.word, self.start = pairs >> 32, pairs & 0xFFFFFFFF, own[0]
        counts = np.zeros((COUNTS, len(pairs) + len(words)), dtype=np.int64)
        counts[:2, : len(pairs)] = np.bincount(self.at, minlength=len(pairs)), np.bincount(self.at[marks], minlength=len(pairs))
        for n, places in enumerate((ids, ids[marks], lasts, lasts[chosen[some]])):
            counts[n, len(pairs) :] = np.bincount(places, minlength=len(words))
        # START comes before the first word of each text, so it stands in for the last one.
        counts[2:, len(pairs) + own[0]] = -some.sum(), -(some & chosen).sum()
        hashes = np.concatenate([_mixed(words[self.first], words[self.word]), _mixed(_mixed(words, 1), 1)]).view(np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.counts = hashes[self.order], counts[:, self.order]

    def take(self, counts: np.ndarray) -> None:
        """Sums over all blocks, in the order of `hashes`, by pair and by word."""
        self.counts = np.empty_like(counts)
        self.counts[:, self.order] = counts

    def losses(self, model: int, tokens: int, size: int, backoff: float) -> np.ndarray:
        """The negative log probability of each pair under one of the models (0 background, 1 target)."""
        both, word = np.split(self.counts[model], [len(self.first)])
        first = (word - self.counts[model + 2, len(self.first) :])[self.first]
        high = np.divide(both, first, out=np.zeros(len(both)), where=first > 0)
        return -np.log((1 - backoff) * high + backoff * (word[self.word] + 1) / (tokens + size))

    def sums(self, losses: np.ndarray) -> np.ndarray:
        """Sums of losses per document."""
        running = np.concatenate([[0.0], np.cumsum(losses[self.at])])
        return np.diff(running[np.concatenate([[0], self.ends])])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k] for name in batch.schema.names}


def asked(ranges: int):
    """(range, block, size, sent): the keys and counts of a block by range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            places = ((block.hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            numbers, starts = np.unique(places, return_index=True)
            ends = [*starts[1:].tolist(), len(places)]
            sent = [packed(np.diff(block.hashes[a:b], prepend=np.uint64(0)), *block.counts[:, a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
            sizes = np.diff([*starts, len(places)])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(len(numbers), row["block"].as_py())), pa.array(sizes), pa.array(sent, pa.binary())], ["range", "block", "size", "sent"])

    return run


def answered(table: pa.Table) -> pa.Table:
    """The sums over all blocks for what each block sent, in its order."""
    sizes = table.column("size").to_numpy()
    parts = [unpacked(blob.as_py(), size, "<u8", *["<i8"] * COUNTS) for blob, size in zip(table.column("sent"), sizes, strict=True)]
    keys = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    order = np.argsort(keys, kind="stable")
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) > 0)
    sums = np.zeros((COUNTS, number.max() + 1), dtype=np.int64)
    for n in range(COUNTS):
        np.add.at(sums[n], number, np.concatenate([p[n + 1] for p in parts]))
    ends = np.cumsum(sizes)
    back = [packed(*sums[:, number[a:b]]) for a, b in zip(ends - sizes, ends, strict=True)]
    return pa.table([table.column("range"), table.column("block"), table.column("size"), pa.array(back, pa.binary())], ["range", "block", "size", "back"])


def scored(totals: tuple[int, int], size: int, backoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            block = Block(row)
            answers = sorted(row["answers"].as_py(), key=lambda a: a["range"])
            block.take(np.concatenate([np.stack(unpacked(a["back"], a["size"], *["<i8"] * COUNTS)) for a in answers], axis=1))
            background, target = (block.sums(block.losses(n, totals[n], size, backoff)) for n in (0, 1))
            yield pa.RecordBatch.from_arrays([block.keys, block.lengths, pa.array(target), pa.array(background)], ["row", "n_tokens", "target", "background"])

    return run


def score(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: int | None = None, backoff: float = BACKOFF, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """key, n_tokens, target_loss, background_loss (per token) and their difference `score`; `chosen` has the target's keys."""
    spark: SparkSession = docs.sparkSession
    folder = run_folder(spark)
    words = None if vocabulary is None else vocabulary_of(docs, text, vocabulary)
    target = chosen.select(F.col(key).cast("bigint").alias("row")).distinct()
    rows = docs.select(F.col(key).cast("bigint").alias("row"), F.col(text).alias("text"))
    cut = saved(blocks(rows, words, block_tokens), f"{folder}/blocks")
    # The places of the chosen documents in their blocks; a block's size bounds them.
    places = cut.select("block", F.posexplode(F.arrays_zip("keys", "lengths")).alias("place", "x")).select("block", "place", "x.lengths", F.col("x.keys").alias("row"))
    places = places.join(target, "row").groupBy("block").agg(F.collect_list("place").alias("chosen"), F.sum("lengths").alias("tokens"))
    places = saved(places, f"{folder}/places")
    everything = cut.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    totals = everything, places.agg(F.sum("tokens")).first()[0] or 0
    # START is no word of the vocabulary, the unknown word is one where there is a bound.
    size = cut.select(F.explode("words").alias("w")).where(F.col("w") != START).distinct().count() if words is None else len(words) + 2
    load = cut.join(places.select("block", "chosen"), "block", "left")
    # A range holds the keys of about two blocks; blocks send at most one row a range.
    sent = load.mapInArrow(asked(1 + everything // (2 * block_tokens)), "range bigint, block bigint, size bigint, sent binary")
    back = sent.groupBy("range").applyInArrow(answered, "range bigint, block bigint, size bigint, back binary")
    # A block's size bounds what a group holds.
    answers = back.groupBy("block").agg(F.collect_list(F.struct("range", "size", "back")).alias("answers"))
    done = load.join(answers, "block").mapInArrow(scored(totals, size, backoff), "row bigint, n_tokens bigint, target double, background double")
    per = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).otherwise(0.0)
    return done.select(F.col("row").alias(key), "n_tokens", per("target").alias("target_loss"), per("background").alias("background_loss"), (per("target") - per("background")).alias("score"))
