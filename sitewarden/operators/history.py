"""How long archived credentials were there.

An archive holds several copies of one file (`urlkey`) at different times. A value is present from the copy that first
holds it to the last copy in a row that does; the next readable copy without it ends the interval. Copies that were not
answered with 200, or are no scripts, say nothing about a value and so neither begin nor end anything; a null or empty body
is a copy without values. Repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.operators.acquisition import ARCHIVE_MIME, archive_label, captured
from sitewarden.operators.secrets import judge, masked_value, rule_severity

COPY = ["target_id", "urlkey", "ts"]
VALUE = ["target_id", "urlkey", "rule", "value_hash"]


def readable_copies(index: DataFrame) -> DataFrame:
    """All readable script copies of an archive index with their bodies, as resource rows with `urlkey` and `ts`.

    Rows with a null target, key or time belong to no sequence of copies and are left out.
    """
    scripts = captured(index).filter((F.col("mimetype") == ARCHIVE_MIME) & (F.col("ts") != "timestamp"))
    return scripts.dropna(subset=COPY).select(
        *COPY, F.col("ts").cast("bigint").alias("seq"), F.lit("js").alias("kind"), archive_label().alias("url"), "content"
    )


def numbered_copies(copies: DataFrame) -> DataFrame:
    """Copies `(target_id, urlkey, ts)` with their number in the file's sequence and the time of the next one.

    Rows of one second are one copy. The bodies stay behind; what is sorted per file is its times.
    """
    by_time = Window.partitionBy("target_id", "urlkey").orderBy("ts")
    times = copies.select(*COPY).distinct()
    return times.withColumn("n", F.row_number().over(by_time)).withColumn("next_ts", F.lead("ts").over(by_time))


def values_in_copies(matches: DataFrame) -> DataFrame:
    """`(target_id, urlkey, ts, rule, value_hash, value_masked)`: unsuppressed values, once per copy."""
    hashed = judge(matches).withColumn("value_hash", F.sha2("value", 256))
    return hashed.groupBy(*COPY, "rule", "value_hash").agg(F.min(masked_value(F.col("value"))).alias("value_masked"))


def secret_lifetimes(copies: DataFrame, matches: DataFrame, live: DataFrame) -> DataFrame:
    """One row per file, value and uninterrupted run of copies that hold the value.

    `copies` are rows of :func:`readable_copies`, `matches` the match rows of these, `live` the match rows of what is
    captured now. `gone_since` is the time of the copy that ended the run, null if no later copy did. The last run of a
    value that is live in its target (`live`, by the value itself, not by its mask) has no end.
    """
    seen = values_in_copies(matches).join(numbered_copies(copies), COPY)
    in_order = Window.partitionBy(*VALUE).orderBy("n")
    runs = (
        seen.withColumn("run", F.col("n") - F.row_number().over(in_order))
        .groupBy(*VALUE, "run")
        .agg(
            F.min("value_masked").alias("value_masked"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
            F.count(F.lit(1)).alias("n_copies"), F.max_by("next_ts", "n").alias("gone_since"),
        )
    )
    now = judge(live).select("target_id", "rule", F.sha2("value", 256).alias("value_hash")).distinct()
    marked = runs.join(now.withColumn("live", F.lit(True)), ["target_id", "rule", "value_hash"], "left").withColumn(
        "live", F.coalesce("live", F.lit(False))
    )
    last = F.max("last_seen").over(Window.partitionBy("target_id", "rule", "value_hash"))
    lasting = F.col("live") & (F.col("last_seen") == last)
    return marked.withColumn("gone_since", F.when(~lasting, F.col("gone_since"))).select(
        "target_id", "urlkey", F.col("rule").alias("type"), "value_masked", "value_hash", "first_seen", "last_seen",
        "n_copies", "gone_since", "live", rule_severity(F.col("rule")).alias("severity"),
    )
