"""Reading the given tables, written intermediate tables in the folder that all machines share, and Arrow batches in tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of a batch that become Python objects at a time.
PART_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def run_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write and read again: cuts lineage, and rows with generated keys stay as they are after a lost executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that `saved` wrote, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def whole_numbers(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver, whole numbers only. They travel by Arrow: a list of rows would start workers just to unpickle it."""
    names = [f.split()[0] for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names), schema)


def parts(batches: Iterable[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def stretches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """First place, and the one behind the last, of neighbours whose sizes sum to at most `most`; a larger one stands alone."""
    at = 0
    while at < len(sizes):
        end, room = at + 1, most - sizes[at]
        while end < len(sizes) and room >= sizes[end]:
            room -= sizes[end]
            end += 1
        yield at, end
        at = end


def released() -> None:
    """Memory that nothing holds goes back to the system, where the libraries can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step `run` of mapInArrow, with its memory given back at the end: the worker stays, its next task may be of another kind."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return steps
