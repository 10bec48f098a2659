"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice; the faster run counts, the first one, which pays for class loading and code generation, is listed too.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "secret_full", "secret_matches", "secret_match_cap", "secret_dedup", "historical_only_secrets",
    "tech_detect", "builder_detect", "meta_extract", "resource_extract", "resource_inventory",
    "header_audit", "path_exposure", "openapi_audit", "cookie_audit", "form_audit", "comment_leak",
    "sourcemap_leak", "framework_config_keys", "js_dedup", "referenced_js_frontier", "archive_select",
    "wp_report_findings", "builder_detect_all", "repo_links_all", "severity_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, first = {}, {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], first[name] = round(min(runs), 3), round(runs[0], 3)
    spark.stop()
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run": first, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
