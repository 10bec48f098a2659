"""Plans: what is pushed down, what is shuffled, what is limited before the shuffle."""

import re

import pytest

from checks.fixtures import relation
from checks.queries import QUERIES, Inputs
from sitewarden.operators import acquisition as acq
from sitewarden.operators import responses
from sitewarden.operators import secrets as sec
from sitewarden.operators import tool_reports
from sitewarden.plans import audit
from sitewarden.sources.captured import page_resources, read_table
from tests.conftest import SMALL



@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 100_000)
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)


EAGER = {"findings_sink", "scan_stream", "severity_windows", "findings_union", "severity_counts", "severity_bars", "severity_rollup", "grade", "target_digest"}


def physical(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def exchanges(df) -> list[str]:
    return [line for line in physical(df).splitlines() if re.search(r"\bExchange ", line)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join(spark, name):
    text = physical(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_cap_limits_groups_before_each_shuffle(spark):
    rows = page_resources(read_table(spark, SMALL, "pages"))
    text = physical(sec.apply_cap(sec.secret_matches(rows)))
    assert text.count("WindowGroupLimit") == 4
    assert "row_number(), 51, Partial" in text and "row_number(), 51, Final" in text


def test_scan_shuffles_match_rows_only(spark):
    rows = page_resources(read_table(spark, SMALL, "pages"))
    df = sec.secret_findings(rows)
    keys = [re.search(r"hashpartitioning\(([^)]*)\)", e)[1] for e in exchanges(df)]
    assert len(keys) == 2 and "Window" not in physical(df)
    behind, *scan_stage = physical(df).split("Generate explode")
    assert len(scan_stage) == 1 and "content#" not in behind


def test_paths_are_pushed_to_the_scan(spark, tmp_path):
    relation(spark, SMALL, "http_response").write.parquet(str(tmp_path / "r"))
    text = physical(responses.path_exposure(spark.read.parquet(str(tmp_path / "r"))))
    assert re.search(r"PushedFilters: \[.*In\(path, \[.*EqualTo\(status,200\)", text)


def test_findings_read_one_column_of_the_facts(spark, tmp_path):
    facts = audit.facts(audit.page_resources(read_table(spark, SMALL, "pages")))
    facts.write.parquet(str(tmp_path / "f"))
    written = spark.read.parquet(str(tmp_path / "f"))
    schema = re.search(r"ReadSchema: struct<(.*)>", physical(sec.match_rows_of(written)))[1]
    assert schema.startswith("target_id:bigint,seq:bigint,kind:string,url:string,secrets:array")
    assert "comments" not in schema and "forms" not in schema


def test_facts_are_one_stage(spark):
    df = audit.facts(audit.page_resources(read_table(spark, SMALL, "pages")))
    assert not exchanges(df) and physical(df).count("FileScan") == 1 and physical(df).count("ArrowEvalPython") == 1


def test_archive_bodies_do_not_enter_windows(spark):
    index = relation(spark, SMALL, "archive_index")
    lines = [x for x in physical(acq.archive_select(index)).splitlines() if "Window" in x or "Exchange" in x]
    assert lines and not any("content" in x for x in lines)


def test_report_lines_are_scanned_without_join(spark):
    text = physical(tool_reports.wp_report_findings(Inputs(spark, SMALL).tool_report))
    assert "Join" not in text and "Exchange" not in text
