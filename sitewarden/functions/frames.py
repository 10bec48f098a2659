"""First-k per group without collecting a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each group.

    A rank filter with a constant limit is planned as a group limit on both sides of the shuffle: each
    map task sends at most k rows of a group, so a group that holds a third of all rows does not arrive
    in one task. ``rank`` keeps the rank (1..k) under that name.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out.withColumn(rank, F.col(rank).cast("bigint")) if rank else out.drop(name)


def drop_large_groups(df: DataFrame, keys: list[str], order: list[str], cap: int, salts: int = 64) -> DataFrame:
    """Drop every group with more than ``cap`` rows, exactly and in one pass over ``df``.

    cap + 1 rows of a group are enough to know that it is too large. The first limit works on salted
    groups: a map task sends at most cap + 1 rows of a group, to the task of its own salt, so a hot group
    is spread over ``salts`` tasks. The second limit sees at most salts * (cap + 1) rows of a group, the
    count at most cap + 1. Which rows of a too large group get that far does not matter, as all of them
    are dropped; groups within the cap keep all their rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    few = first_k(salted, [*keys, "_salt"], order, cap + 1).drop("_salt")
    fewer = first_k(few, keys, order, cap + 1)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return fewer.withColumn("_size", size).filter(F.col("_size") <= cap).drop("_size")


def ordered_text(entries: Column, separator: str) -> Column:
    """Aggregate: texts of ``struct(order, text)`` entries joined in order. Only for bounded groups."""
    ordered = F.sort_array(F.collect_list(entries))
    return F.array_join(F.transform(ordered, lambda e: e["text"]), separator)
