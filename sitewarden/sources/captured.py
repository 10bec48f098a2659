"""Readers of captured artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A captured table; the file carries its schema, column pruning and pushdown stay with the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def stream_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A captured table as a stream of its files, whether it is one file or a folder of them.

    A single file is named by a pattern: as a plain path, a stream would take it for a folder of partitions.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    files = spark.readStream.schema(spark.read.parquet(path).schema)
    return files.parquet(path if folder else path[:-1] + f"[{path[-1]}]")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Captured JSON lines with a fixed schema; no inference pass, bad lines give null fields."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tool reports line by line (column ``line``)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def page_source(pages: DataFrame) -> DataFrame:
    """Status, final address and size of each captured page."""
    return pages.select(
        "target_id",
        "url",
        "final_url",
        F.col("status").cast("bigint").alias("status"),
        F.length("html").cast("bigint").alias("size"),
    )


def page_resources(pages: DataFrame, *extra: str) -> DataFrame:
    """Pages in the shape of the resource table (kind ``html``, first in scan order)."""
    return pages.select(
        F.col("page_id").alias("target_id"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("html").alias("kind"),
        F.lit("HTML page").alias("url"),
        F.col("html").alias("content"),
        *extra,
    )
