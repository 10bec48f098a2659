"""Readers and small inputs."""

import pytest

from checks.fixtures import planted_html
from checks.queries import QUERIES
from sitewarden.operators import secrets as sec
from sitewarden.sources import captured, sinks
from sitewarden.streaming import scan


def test_bad_json_lines_give_null_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"target_id": 1, "path": "/.env", "status": 200}\n{broken\n')
    rows = captured.read_json_lines(spark, str(tmp_path), "target_id bigint, path string, status int")
    assert sorted((r.target_id, r.path) for r in rows.collect() if r.target_id) == [(1, "/.env")]
    assert rows.count() == 2


def test_report_lines(spark, tmp_path):
    (tmp_path / "wp.log").write_text('{"target": 1}\nnot json\n')
    assert [r.line for r in captured.read_text_lines(spark, str(tmp_path)).collect()] == ['{"target": 1}', "not json"]


def test_null_and_empty_texts_are_scanned(spark):
    from sitewarden.operators import secrets as sec

    rows = spark.createDataFrame(
        [(1, 0, "html", "u", None), (2, 0, "html", "u", ""), (3, 0, "html", "u", "glpat-" + "a" * 20)],
        "target_id bigint, seq bigint, kind string, url string, content string")
    assert [r.target_id for r in sec.secret_findings(rows).collect()] == [3]


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def captured_pages(spark, root, files):
    """Pages with a credential in a table that is a folder of files, or one file."""
    rows = [(n, f"https://s{n}.example.com/", f"<i>{n}</i>") for n in range(6)]
    folder = root / "pages.parquet"
    whole = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    if files > 1:
        whole.repartition(files).write.parquet(str(folder))
    else:
        whole.coalesce(1).write.parquet(str(root / "made"))
        next((root / "made").glob("*.parquet")).rename(folder)
        (root / "old").mkdir()
        whole.coalesce(1).write.parquet(str(root / "old" / "pages.parquet"))  # another table of that name further down
    return str(root)


@pytest.mark.parametrize("files", [3, 1])
def test_stream_of_a_folder_or_a_file(spark, tmp_path, few_partitions, files):
    root = captured_pages(spark, tmp_path, files)
    (captured.stream_table(spark, root, "pages").writeStream.format("memory").queryName(f"streamed_{files}").trigger(availableNow=True)
     .start().awaitTermination())
    assert sorted(r.page_id for r in spark.table(f"streamed_{files}").collect()) == list(range(6))


def test_stream_queries_of_a_folder(spark, tmp_path, few_partitions):
    root = captured_pages(spark, tmp_path, 3)
    columns = ["target_id", "type", "value_masked", "location", "context", "severity", "n_values"]
    batch = sec.secret_findings(captured.page_resources(spark.read.parquet(f"{root}/pages.parquet").transform(planted_html))).select(columns).collect()
    assert len(batch) >= 6
    assert sorted(map(tuple, QUERIES["scan_stream"](spark, root).collect())) == sorted(map(tuple, batch))
    assert sum(r.n for r in QUERIES["severity_windows"](spark, root).collect()) == len(batch)
    each = QUERIES["findings_stream_sink"](spark, root).select(columns[:-1]).collect()
    assert sorted(map(tuple, each)) == sorted(tuple(r)[:-1] for r in batch)


def test_a_stream_without_files_has_no_findings(spark, tmp_path):
    folder = str(tmp_path / "sink")
    assert scan.present(spark, folder).count() == 0 and scan.late(spark, folder).count() == 0
    assert sinks.read_batches(spark, folder, f"{scan.VALUE}, batch int").columns[-1] == "batch"
