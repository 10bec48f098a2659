"""Packing of tokenized documents into sequences of fixed capacity by cutting-stock column generation.

A document is its ids and a closing id. Full pieces of `capacity` ids fill sequences of their own; the rest of each
document is one shorter piece. The shorter pieces are counted by length class, a linear program over patterns (how many
pieces of each class go into one sequence) is solved on that histogram, a knapsack recursion prices new patterns, and
the rounded patterns are dealt to the ranked pieces. What rounding leaves over is packed first-fit by falling length.

Only the histogram (at most `capacity / step` numbers) reaches the driver, only the patterns go back. Pieces are ranked
from counts per task, so no length, however common, passes through one task.

Null text counts as empty: one piece with the closing id. Repeated rows are separate documents. An empty table gives no
rows. Other columns of the input are not used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.merges import BatchEncoder
from sitewarden.llm.tables import run_folder, saved, stretches, tidy, whole_numbers

#: Tokens of a sequence, and the width of a length class.
CAPACITY, STEP = 1024, 4
#: Column generation stops when the proven gap to the best possible number of sequences is below this share.
GAP = 0.001
CLOSING_ID = 0
#: Characters of the texts that are encoded together; a longer text is encoded alone.
BATCH_CHARS = 1 << 21

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, class int, place bigint"


class Tokens:
    """A tokenizer file; workers keep theirs between tasks."""

    _kept: dict[str, Tokens] = {}

    def __init__(self, path: str):
        self.encoder = BatchEncoder(path)

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, texts: str | list[str]) -> bytes | Iterator[bytes]:
        """Little-endian ids of a text, or of each of a list."""
        return next(self._each([texts])) if isinstance(texts, str) else self._each(texts)

    def _each(self, texts: list[str]) -> Iterator[bytes]:
        for at, end in stretches([len(t) for t in texts], BATCH_CHARS):
            yield from (ids.astype("<u4").tobytes() for ids in self.encoder(texts[at:end]))


def length_class(length: int, step: int = STEP) -> int:
    """The least multiple of `step` that holds the length."""
    return -(-length // step) * step


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """The pieces of each document with their place among those of one class in one task; no shuffle."""

    def sizes_of(batch: pa.RecordBatch) -> list[int]:
        return pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, places = Tokens.of(path), TaskContext.get().partitionId(), Counter()
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in (b.slice(at, end - at) for b in batches for at, end in stretches(sizes_of(b), BATCH_CHARS)):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(texts), strict=True):
                ids += CLOSING_ID.to_bytes(4, "little")
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    kind = length_class(len(part) // 4, step)
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, task, kind, places[kind]))
                    places[kind] += 1
            if rows:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(tidy(run), PIECES)


@dataclass
class Pattern:
    """`times` sequences that hold `counts[class]` pieces of each class."""

    counts: dict[int, int]
    times: int


def best_pattern(values: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by recursion over the room left: the pattern of highest value."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(weights, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if k := upto[room]:
            gain = best[room - weights[:k]] + values[:k]
            j = int(gain.argmax())
            if gain[j] > 0:
                best[room], took[room] = gain[j], j
    counts, room = np.zeros(len(weights)), capacity
    while took[room] >= 0:
        counts[took[room]] += 1
        room -= int(weights[took[room]])
    return float(best[capacity]), counts


def solve(histogram: dict[int, int], capacity: int = CAPACITY, step: int = STEP, gap: float = GAP) -> list[Pattern]:
    """Patterns that hold every counted piece exactly once."""
    weights = np.array(sorted(w for w, n in histogram.items() if n), dtype=int)
    if not len(weights):
        return []
    need = np.array([histogram[int(w)] for w in weights], dtype=float)
    units, room = weights // step, capacity // step
    # The first basis fills sequences with pieces of one class.
    columns = [np.eye(len(weights))[i] * (room // units[i]) for i in range(len(weights))]
    inverse = np.diag([1 / c[i] for i, c in enumerate(columns)])
    x = inverse @ need
    for _ in range(40 * len(weights)):
        prices = inverse.sum(axis=0)
        value, column = best_pattern(prices, units, room)
        if value <= 1 + 1e-9 or 1 - 1 / value < gap:  # x.sum() / value is a lower bound
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        columns[out] = column
        x = np.maximum(inverse @ need, 0)
    left = need.astype(np.int64)
    patterns = []
    for column, times in zip(columns, np.floor(x + 1e-9).astype(np.int64), strict=True):
        counts = column.astype(np.int64)
        fits = [left[i] // counts[i] for i in np.flatnonzero(counts)]
        times = min([int(times), *map(int, fits)])
        if times > 0:
            left -= counts * times
            patterns.append(Pattern({int(weights[i]): int(counts[i]) for i in np.flatnonzero(counts)}, times))
    return patterns + first_fit({int(w): int(n) for w, n in zip(weights, left, strict=True) if n}, capacity)


def first_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """What is left over, by falling length: each sequence takes of every class as many as still fit."""
    left, patterns = dict(sorted(histogram.items(), reverse=True)), []
    while left:
        counts, room = {}, capacity
        for w, n in left.items():
            if take := min(n, room // w):
                counts[w] = take
                room -= take * w
        times = min(left[w] // c for w, c in counts.items())
        patterns.append(Pattern(counts, times))
        left = {w: rest for w, n in left.items() if (rest := n - counts.get(w, 0) * times)}
    return patterns


def pattern_rows(patterns: list[Pattern]) -> list[tuple]:
    """(class, first rank, rank behind the last, first sequence, pieces of the class in a sequence, place of the class)."""
    used, rows, sequence = Counter(), [], 0
    for p in patterns:
        for slot, (kind, each) in enumerate(sorted(p.counts.items(), reverse=True)):
            rows.append((kind, used[kind], used[kind] + each * p.times, sequence, each, slot))
            used[kind] += each * p.times
        sequence += p.times
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, step: int = STEP, gap: float = GAP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % step:
        raise ValueError("capacity must be a multiple of step")
    spark = docs.sparkSession
    pieces = saved(token_pieces(docs, path, capacity, step), f"{run_folder(spark)}/pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    rows = pattern_rows(solve(histogram, capacity, step, gap))
    # Bounded: a row for each class of a pattern, and there are about as many patterns as classes.
    patterns = whole_numbers(spark, rows, "class int, low long, high long, first long, each long, slot int")
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    ranked = pieces.join(offsets, ["class", "part"]).withColumn("rank", F.col("ahead") + F.col("place"))
    dealt = ranked.join(F.broadcast(patterns), "class").where("rank >= low AND rank < high")
    dealt = dealt.withColumn("sequence_id", F.expr("first + (rank - low) div each"))
    before = Window.partitionBy("sequence_id").orderBy("slot", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
