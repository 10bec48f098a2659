"""Writers of findings and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, root: str | None = None) -> str:
    """A fresh folder below ``root``, or below the shared one named by ``spark.checkpoint.dir``.

    Only a local session may do without both; executors of a cluster do not see each other's local folders.
    """
    root = root or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="sitewarden-")
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


def materialize(df: DataFrame, folder: str) -> DataFrame:
    """Write a narrow intermediate result once and continue from the written table.

    Rebalancing evens out the files: a scan leaves one small piece per input split.
    """
    df.hint("rebalance").write.mode("errorifexists").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate tables from whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_findings(findings: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Parquet files by severity.

    Rows go to files by (severity, part of the targets), so that a severity that holds most findings is
    written by many tasks and each task opens few files.
    """
    parts = findings.sparkSession.sparkContext.defaultParallelism
    spread = findings.withColumn("_part", F.pmod(F.xxhash64("target_id"), F.lit(parts)))
    spread.repartition("severity", "_part").drop("_part").write.mode(mode).partitionBy("severity").parquet(folder)


def batch_writer(folder: str):
    """A function for ``foreachBatch`` that writes findings by severity so that a replayed batch leaves the same files.

    A batch is its own partition below each severity, and writing it replaces that partition only. A row in the ledger,
    written last, says that a batch is whole and how many rows it has; a batch in the ledger is not written again, and rows
    without a ledger row (of a writer that died) are not read.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        ledger = f"{folder}/ledger/batch={batch}"
        if exists(spark, f"{ledger}/_SUCCESS"):
            return
        rows = rows.withColumn("batch", F.lit(batch))
        parts = spark.sparkContext.defaultParallelism
        spread = rows.withColumn("_part", F.pmod(F.xxhash64("target_id"), F.lit(parts))).repartition("severity", "_part").drop("_part")
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("severity", "batch").parquet(f"{folder}/findings")
        counts = _batches(spark, folder, _ddl(rows)).filter(F.col("batch") == batch).agg(F.count(F.lit(1)).alias("n_rows"))
        counts.coalesce(1).write.mode("overwrite").parquet(ledger)

    return write


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def _batches(spark: SparkSession, folder: str, schema: str | None) -> DataFrame:
    if schema is not None and not exists(spark, f"{folder}/findings"):
        return spark.createDataFrame([], schema)
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(f"{folder}/findings")


def read_batches(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All rows of whole batches, with ``severity`` and ``batch``; none if there was no batch. Without a schema there has to
    be a row."""
    if schema is not None and not exists(spark, f"{folder}/ledger"):
        return spark.createDataFrame([], schema)
    whole = spark.read.schema("n_rows bigint, batch int").parquet(f"{folder}/ledger").select("batch").distinct()
    return _batches(spark, folder, schema).join(whole, "batch", "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
