"""Run every query next to its SQL on the second engine and compare rows.

    python -m checks.compare [data directory] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def rows_of(rows, columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when both engines agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.collect(), df.columns)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(cursor.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        return f"{sum(mine.values())} / {sum(theirs.values())} rows; only here {list(extra)[:2]}; only there {list(missing)[:2]}"
    types = {c: t for c, t in df.dtypes if t not in ("bigint", "string", "boolean", "double")}
    return f"types {types}" if types else None


def session(cores: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitewarden-checks")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark, con, wrong = session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        n = "" if problem else f"{QUERIES[name](spark, sf_dir).count()} rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {time.time() - start:5.1f} s {problem or n}", flush=True)
        wrong += problem is not None
    print(f"{len(names) - wrong} of {len(names)} agree")
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
