"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.tables import dropped, saved


def forest(links: np.ndarray, n: int) -> np.ndarray:
    """For each node the smallest node it reaches."""
    top = np.arange(n)
    while len(links):
        a, b = top[links[:, 0]], top[links[:, 1]]
        if (a == b).all():
            break
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(top, high, low)
        while (top != top[top]).any():
            top = top[top]
    return top


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Each round hangs the larger neighbours of a node to the smallest one, then the smaller neighbours; the number of
    rounds is about the logarithm of the longest path. Rounds are written tables. A node with very many edges takes
    part as the hot side of a join that Spark splits, and as partial minima before a shuffle.
    """
    spark = edges.sparkSession
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = saved(stars, f"{folder}/stars-0")
    n, before = 0, None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, n = state, n + 1
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large, f"{folder}/large-{n}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        old, stars = f"{folder}/stars-{n - 1}", saved(small, f"{folder}/stars-{n}")
        dropped(spark, old)
        dropped(spark, f"{folder}/large-{n}")
    tops = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
