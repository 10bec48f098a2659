"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on `lines` random orthonormal directions. Rows of one label are sorted by the first projection
and cut into blocks; two blocks meet only if their windows on it overlap, which loses no pair, as a pair of cosine c is
at most sqrt(2 - 2c) apart on any line. In a pair of blocks every vector's narrow window on each line is compared with
the other block, and a pair that falls into the window on at least `count` lines is verified by its cosine in double
precision. `count` is the largest for which a pair right at the threshold is lost with a probability below `miss`.

Equal vectors are one class, so copies cost nothing. A pair of blocks returns sums and a spanning forest instead of its
links: a class with thousands of near copies yields as many rows as it has vectors per block, not their square.

Vectors that are null, empty or zero, or hold null or non-finite components, or whose label is null, link with nothing. Labels of any type are compared by their text.
Vectors of different lengths link with nothing. Ids may be tied: rows with one id are one vector each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.components import components, forest
from sitewarden.llm.tables import run_folder, saved

THRESHOLD, LINES, MISS, BLOCK = 0.98, 32, 1e-7, 1024
#: Half the width of a window, in standard deviations of a pair at the threshold.
WIDTH = 2.0

BLOCKS = "label string, dims int, block string, low double, high double, ids binary, copies binary, vectors binary"
LINKS = "a bigint, b bigint, n bigint"


def directions(dims: int, lines: int, seed: int = 7) -> np.ndarray:
    """Up to `dims` orthonormal columns."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q[:, : min(lines, dims)]


def least_count(lines: int, hit: float, miss: float) -> int:
    """The largest count that at most a share `miss` of pairs with `lines` independent windows, each hit with `hit`, stays below."""
    below = 0.0
    for k in range(lines + 1):
        below += math.comb(lines, k) * hit**k * (1 - hit) ** (lines - k)
        if below > miss:
            return k
    return lines


def window(dims: int, threshold: float, width: float = WIDTH) -> tuple[float, float]:
    """Half width of the window and the probability that a pair at the threshold falls into it."""
    sd = math.sqrt((2 - 2 * threshold) / dims)
    return width * sd, math.erf(width / math.sqrt(2))


def blocks_of(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (label, dims, low, id, copies, vector) as packed blocks of one label."""
    from pyspark import TaskContext

    names, task, number = [f.split()[0] for f in BLOCKS.split(", ")], TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def packed() -> pa.RecordBatch:
        label, dims = held[0][:2]
        columns = [
            [label], [dims], [f"{task}-{number}"], [held[0][2]], [held[-1][2]],
            [np.array([h[3] for h in held], "<i8").tobytes()], [np.array([h[4] for h in held], "<i8").tobytes()],
            [np.array([h[5] for h in held], "<f8").tobytes()],
        ]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in rows:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and (row[:2] != held[0][:2] or len(held) == size):
                yield packed()
                held, number = [], number + 1
            held.append(row)
    if held:
        yield packed()


def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place on the first line and replaces vectors by unit vectors."""
    for batch in batches:
        rows = [np.array(v, dtype=np.float64) for v in batch.column("vector").to_pylist()]
        rows = [v / np.abs(v).max() for v in rows]  # no overflow in the norm
        rows = [v / np.linalg.norm(v) for v in rows]
        low = [float(v @ directions(len(v), 1)[:, 0]) for v in rows] if len({len(v) for v in rows}) > 1 else (np.array(rows) @ directions(len(rows[0]), 1)[:, 0]).tolist() if rows else []
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("dims"), pa.array(low, pa.float64()), batch.column("id"), batch.column("copies"), pa.array([v.tolist() for v in rows], pa.list_(pa.float64()))],
            ["label", "dims", "low", "id", "copies", "vector"],
        )


def linked(x: np.ndarray, y: np.ndarray, threshold: float, lines: int, miss: float) -> np.ndarray:
    """(i, j) of the pairs of two blocks that pass the count and the cosine."""
    half, hit = window(x.shape[1], threshold)
    way = directions(x.shape[1], lines)
    p, q = (x @ way).astype(np.float32), (y @ way).astype(np.float32)
    lines = way.shape[1]
    need = least_count(lines, hit, miss)
    hits, found = np.zeros((len(x), len(y)), dtype=np.int8), None
    for k in range(lines):
        if found is None:
            hits += np.abs(p[:, None, k] - q[None, :, k]) <= half
            if k == lines // 2:  # from here on only pairs that can still reach the count
                i, j = np.nonzero(hits >= need - (lines - 1 - k))
                found, count = (i, j), hits[i, j].astype(np.int16)
        else:
            i, j = found
            count += np.abs(p[i, k] - q[j, k]) <= half
            stay = count >= need - (lines - 1 - k)
            found, count = (i[stay], j[stay]), count[stay]
    i, j = found if found is not None else np.nonzero(hits >= need)
    close = np.empty(len(i), dtype=bool)
    for k in range(0, len(i), 1 << 18):
        s = slice(k, k + (1 << 18))
        close[s] = np.einsum("nd,nd->n", x[i[s]], y[j[s]]) >= threshold
    return np.stack([i[close], j[close]], 1)


def block_links(threshold: float, lines: int, miss: float):
    """Per pair of blocks: (a, null, links of a) and (a, b, null) for a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = [np.frombuffer(row[k], "<i8") for k in ("ids", "ids2")]
                copies = [np.frombuffer(row[k], "<i8") for k in ("copies", "copies2")]
                x, y = (np.frombuffer(row[k], "<f8").reshape(-1, row["dims"]) for k in ("vectors", "vectors2"))
                same = row["block"] == row["block2"]
                links = linked(x, y, threshold, lines, miss)
                if same:
                    links = links[links[:, 0] < links[:, 1]]
                if not len(links):
                    continue
                i, j = links.T
                nodes = np.concatenate([ids[0], ids[1]])
                n = np.bincount(i, copies[1][j], len(nodes)) + np.bincount(j + (0 if same else len(x)), copies[0][i], len(nodes))
                top = forest(np.stack([i, j + (0 if same else len(x))], 1), len(nodes))
                has, child = np.flatnonzero(n), np.flatnonzero(top != np.arange(len(nodes)))
                none = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[has]), none, pa.array(n[has].astype(np.int64))], ["a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[top[child]]), pa.nulls(len(child), pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, lines: int = LINES, miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    folder = run_folder(spark)
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("class", F.when(F.coalesce(usable, F.lit(False)), F.sha2(F.concat_ws(",", F.hex("label"), F.transform("vector", lambda x: F.hex((x + 0.0).cast("string")))), 256)))
    usable = rows.where("class IS NOT NULL")
    classes = usable.groupBy("class").agg(F.min(F.struct("key", "label", "vector")).alias("one"), F.count("*").alias("copies"))
    classes = classes.select("class", F.col("one.label").alias("label"), F.col("one.key").alias("first"), F.col("one.vector").alias("vector"), "copies")
    # A number per class: the vectors of a class have the smallest key, but keys may be tied between classes.
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), f"{folder}/classes")
    ready = classes.select("label", F.size("vector").alias("dims"), "id", "copies", "vector")
    ready = ready.mapInArrow(projected, "label string, dims int, low double, id bigint, copies bigint, vector array<double>")
    ready = ready.repartitionByRange("label", "dims", "low").sortWithinPartitions("label", "dims", "low")
    cut = saved(ready.mapInArrow(lambda it: blocks_of(it, block), BLOCKS), f"{folder}/blocks")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    head = cut.select("label", "dims", "block", "low", "high")
    other = head.select("label", "dims", *[F.col(c).alias(c + "2") for c in ("block", "low", "high")])
    pairs = head.join(other, ["label", "dims"]).where((F.col("block") <= F.col("block2")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
    pairs = pairs.select("dims", "block", "block2").repartition("block", "block2")
    load = cut.select("block", "ids", "copies", "vectors")
    pairs = pairs.join(load, "block").join(load.select(*[F.col(c).alias(c + "2") for c in load.columns]), "block2")
    links = saved(pairs.mapInArrow(block_links(threshold, lines, miss), LINKS), f"{folder}/links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    tops = components(links.where("b IS NOT NULL").select("a", "b"), f"{folder}/components").withColumnRenamed("node", "id")
    groups = classes.select("class", "id", "first", "copies").join(tops, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(least, "component").join(counts, "id", "left").select("class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    done = rows.drop("vector", "label").join(groups, "class", "left")
    return done.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "key").alias("component_id"), (F.col("key") == F.coalesce("component_id", "key")).alias("kept"),
    )
