"""Hard negatives of anchors by slots of scores.

Every anchor has its first positives, and each positive opens a window of scores below its own: from `low` to `high` of it.
Windows of one anchor overlap. Their upper limits, in falling order, cut the scores into slots that do not: slot j ends at
the limit of positive j and begins above the next one. The first k negatives of every slot are enough for all windows, as
the first k at or below an upper limit are among the first k of its slot and of those after it. So tasks keep k rows per
anchor and slot whatever the number of windows, partial results are merged by rank, and the lists of an anchor are read
once from the highest slot down: each window takes the first k of its slots' rest that reach its lower limit.

Anchors are the stated rows, in blocks, against all rows, in blocks; a task merges what it found before it answers. Scores
are inner products of components rounded down to whole 256ths, exact in a long and stopped at its ends. Vectors of
different lengths are compared as if the shorter one went on with zeros; an empty vector scores 0.

Rows without id, label or vector, or with a component that is null or not finite, take no part; labels that are not whole
numbers count as null. Rows that share an id are one row, the first by label, then by vector. Ties of scores go to the
smaller id. An anchor without positives, or whose windows are empty, has no rows; neither has an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitewarden.llm.tables import run_folder, saved

POSITIVES, NEGATIVES = 5, 3
#: Windows in twentieths of the positive's score.
LOW, HIGH = 10, 19
SCALE = 256.0
ANCHOR_BLOCK, ROW_BLOCK = 512, 2048
#: A task answers when it has merged this many blocks of anchors.
HELD = 64
LONG = np.iinfo(np.int64)

BLOCK = "ids binary, labels binary, vectors binary, dims int, limits binary"
FOUND = "anchor bigint, slot int, score bigint, id bigint"


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vector of the rows that take part, one per id."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).try_cast("bigint").alias("id"), F.col(label).try_cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.forall("vector", finite))
    return rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*")


def packed(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (id, label, vector, limits) as one block, in order of their ids; shorter vectors go on with zeros."""
    rows.sort(key=lambda r: r[0])
    dims = max(len(r[2]) for r in rows)
    whole = np.zeros((len(rows), dims))
    for n, r in enumerate(rows):
        whole[n, : len(r[2])] = r[2]
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(whole * SCALE), -np.finfo(np.float64).max, np.finfo(np.float64).max)
    if not whole.size or np.abs(whole).max() < 2**24:
        whole = whole.astype("<f4")  # exact, and half as long
    columns = [np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"), whole, None, np.array([r[3] for r in rows], "<i8")]
    made = [pa.array([dims], pa.int32()) if c is None else pa.array([c.tobytes()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(made, [f.split()[0] for f in BLOCK.split(", ")])


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, vector, limits array) as blocks; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                if len(held) == size:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return rows.select("id", "label", "vector", "limits").mapInArrow(run, BLOCK)


class Block:
    def __init__(self, row: dict, prefix: str):
        get = lambda name: row[prefix + name]
        self.ids, self.labels = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("labels"), "<i8")
        self.limits = np.frombuffer(get("limits"), "<i8").reshape(len(self.ids), -1)
        size = len(self.ids) * get("dims")
        self.vectors = np.frombuffer(get("vectors"), "<f4" if len(get("vectors")) == 4 * size else "<f8").reshape(len(self.ids), -1).astype(np.float64)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact up to the ends of a long."""
    dims = min(x.shape[1], y.shape[1])
    x, y = x[:, :dims], y[:, :dims]
    if not dims:
        return np.zeros((len(x), len(y)), dtype=np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * dims < 2**53:
        return (x @ y.T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in side] for side in (x, y)]
    return np.array([[min(max(sum(a * b for a, b in zip(p, q, strict=True)), LONG.min), LONG.max) for q in whole[1]] for p in whole[0]], dtype=np.int64)


def first_of(group: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group: highest score first, then smallest key."""
    order = np.lexsort((key, ~score, group))  # ~score falls as the score rises, without overflow
    g = group[order]
    begin = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(begin, np.arange(len(g)), 0)) if len(g) else g
    return order[rank < k]


def same_label(a: Block, b: Block, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (anchor, slot 0, row) for the positives; per anchor only scores that reach its k-th best of the block."""
    mask = (a.labels[:, None] == b.labels[None, :]) & (a.ids[:, None] != b.ids[None, :])
    if s.shape[1] > k:
        least = np.partition(np.where(mask, s, LONG.min), -k, axis=1)[:, -k]
        mask &= s >= least[:, None]
    i, j = np.nonzero(mask)
    return i, np.zeros(len(i), dtype=np.int64), j


def in_windows(a: Block, b: Block, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (anchor, slot, row) of another label. limits: upper limits in falling order, then the least lower limit."""
    upper, lower = a.limits[:, :-1], a.limits[:, -1:]
    mask = (a.labels[:, None] != b.labels[None, :]) & (s >= lower) & (s <= upper[:, :1])
    i, j = np.nonzero(mask)
    slot = (upper[i] >= s[i, j][:, None]).sum(axis=1) - 1  # the last limit that the score does not pass
    return i, slot, j


def best(pairs: DataFrame, k: int, candidates) -> DataFrame:
    """(anchor, slot, score, id): the first k per anchor and slot of what each task saw."""

    def answer(kept: dict) -> Iterator[pa.RecordBatch]:
        for anchors, slot, score, key in kept.values():
            columns = [pa.array(anchors), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(key)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                a, b = Block(row, "a_"), Block(row, "")
                s = scores(a.vectors, b.vectors)
                i, slot, j = candidates(a, b, s, k)
                new = a.ids[i], slot, s[i, j], b.ids[j]
                name = row["a_ids"]
                if name not in kept and len(kept) == HELD:
                    yield from answer(kept)
                    kept = {}
                all_ = [np.concatenate(c) for c in zip(kept[name], new, strict=True)] if name in kept else new
                top = first_of(np.unique(np.stack(all_[:2], 1), axis=0, return_inverse=True)[1].ravel(), all_[2], all_[3], k)
                kept[name] = tuple(c[top] for c in all_)
        yield from answer(kept)

    return pairs.mapInArrow(run, FOUND)


def grid(anchors: DataFrame, rows: DataFrame, cells: int) -> DataFrame:
    """Every block of anchors next to every block of rows: row blocks are dealt over cells, anchor blocks go to each cell."""
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int")).repartition(cells, "cell")
    every = anchors.select(*[F.col(c).alias("a_" + c) for c in anchors.columns], F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    return every.repartition(cells, "cell").join(dealt, "cell").drop("cell")


def upper_limit(score: Column) -> Column:
    """HIGH twentieths of a score that is not negative, rounded down, without overflow."""
    return score - F.expr("score div 20") * (20 - HIGH) - F.ceil((score % 20) * (20 - HIGH) / 20)


def lower_limit(score: Column) -> Column:
    """LOW twentieths of a score that is not negative, rounded up, without overflow."""
    return F.expr("score div 20") * LOW + F.ceil((score % 20) * LOW / 20)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot, first: the first k of all tasks' rows, best first. A group has k rows of each task at most, and is merged before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors` is a condition on id, label and vector.
    """
    spark = vectors.sparkSession
    folder = run_folder(spark)
    none = F.expr("cast(array() as array<bigint>)")
    rows = saved(usable(vectors, key, vector, label).withColumn("limits", none), f"{folder}/rows")
    cut = saved(blocks(rows, row_block), f"{folder}/blocks")
    cells = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    asked = rows.where(anchors)
    close = best(grid(blocks(asked, anchor_block), cut, cells), positives, same_label)
    close = ranked(close, positives).select("anchor", "score", F.col("id").alias("positive"))
    # A window below a negative score is empty, as its lower end lies above its upper end.
    close = saved(close.where("score >= 0").select("*", upper_limit(F.col("score")).alias("upper"), lower_limit(F.col("score")).alias("lower")), f"{folder}/positives")
    # Limits fall from slot to slot; an anchor with fewer positives has its last limit several times, which leaves slots empty.
    upper = F.reverse(F.array_sort(F.collect_list("upper")))
    full = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda n: F.element_at("u", F.least(n + 1, F.size("u"))))
    limits = close.groupBy("anchor").agg(upper.alias("u"), F.min("lower").alias("l")).select(F.col("anchor").alias("id"), F.concat(full, F.array("l")).alias("limits"))
    opened = asked.drop("limits").join(limits, "id")
    found = best(grid(blocks(opened, anchor_block), cut, cells), negatives, in_windows)
    # From the highest slot down: all a window can see is what lies in its slots, in falling order of scores.
    falling = ranked(found, negatives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.expr("~score").alias("fall"), "id"))).alias("falling"))
    inside = F.filter("falling", lambda x: (F.bitwise_not(x.fall) <= F.col("upper")) & (F.bitwise_not(x.fall) >= F.col("lower")))
    out = close.join(falling, "anchor").select("anchor", "positive", "score", F.posexplode(F.slice(inside, 1, negatives)).alias("n", "one"))
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("n") + 1).cast("int").alias("rank"),
        F.col("one.id").alias("negative_id"), F.col("score").alias("positive_score"), F.bitwise_not("one.fall").alias("negative_score"),
    )
