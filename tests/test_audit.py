"""The whole audit, its frontier, roll-up and the stream."""

import tempfile
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.fixtures import planted_html, relation
from sitewarden.operators import cookies, headers, javascript, responses, rollup, tool_reports
from sitewarden.operators import secrets as sec
from sitewarden.plans import audit
from sitewarden.sources import sinks
from sitewarden.sources.captured import page_resources, read_table
from sitewarden.streaming import scan
from tests.conftest import SMALL

TOKEN = {n: "glpat-" + n * 20 for n in "abcdef"}
LONG = " " * 60


def folder():
    return f"{tempfile.mkdtemp(prefix='sitewarden-test-')}/run"


@pytest.fixture
def site(spark):
    """A page that links a script and names a build; a manifest, its chunk and a file the chunk names."""
    root = "https://s.example.com"
    page = ("<script src='/a.js'></script><script>self.__NEXT_DATA__={\"buildId\":\"b1\"}</script>"
            f"<link rel='preload stylesheet' href='m.css'><p>{TOKEN['a']}</p>")
    bodies = [
        (1, f"{root}/a.js", 200, f"eval(x);'/static/chunks/k.js';{TOKEN['b']}"),
        (1, f"{root}/m.css", 404, TOKEN["f"]),
        (1, f"{root}/_next/static/b1/_buildManifest.js", 200, "[\"static/c1.js\",\"short.js\"]"),
        (1, f"{root}/_next/static/c1.js", 200, f"'/_next/static/css/s.css' {TOKEN['c']}" + LONG),
        (1, f"{root}/_next/static/short.js", 200, TOKEN["f"].replace("f" * 6, "g" * 6)),
        (1, f"{root}/static/chunks/k.js", 200, TOKEN["d"] + LONG),
        (1, f"{root}/_next/static/css/s.css", 200, TOKEN["e"] + LONG),
        (1, f"{root}/unknown.js", 200, TOKEN["f"] + LONG),
        (2, f"{root}/a.js", 200, TOKEN["f"] + LONG),
    ]
    return audit.Captured(
        pages=spark.createDataFrame([(1, f"{root}/x/", page.replace("m.css", "/m.css"))],
                                    "page_id bigint, url string, html string"),
        resource_body=spark.createDataFrame(bodies, "target_id bigint, url string, status int, content string"),
    )


def test_frontier_reaches_two_steps_and_no_further(site):
    result = audit.run(site, folder())
    places = {r.value_masked[6:12]: r.location for r in result.modules["secrets"].collect()}
    root = "https://s.example.com"
    assert places == {
        "a" * 6: "HTML page", "b" * 6: f"{root}/a.js", "c" * 6: f"{root}/_next/static/c1.js",
        "d" * 6: f"{root}/static/chunks/k.js", "e" * 6: f"{root}/_next/static/css/s.css",
        "g" * 6: f"{root}/_next/static/short.js",
    }
    assert [r.pattern for r in result.modules["js"].collect()] == ["eval("]


def test_archived_scripts_take_part(spark):
    rows = relation(spark, SMALL, "archive_index").filter("target_id < 3")
    pages = read_table(spark, SMALL, "pages").filter("page_id < 3")
    result = audit.run(audit.Captured(pages=pages, archive_index=rows), folder())
    found = {(r.target_id, r.type, r.location) for r in result.modules["secrets"].collect()}
    assert (0, "GitLab Token", "[ARCHIVE] http://old.example.com/1.js") in found
    assert (2, "AWS Access Key", "[ARCHIVE] http://old.example.com/2.js") in found


def test_only_captured_tables_give_modules(spark):
    result = audit.run(audit.Captured(pages=read_table(spark, SMALL, "pages")), folder())
    assert set(result.modules) == {"transport", "builders", "secrets", "forms", "leaks", "js"}
    assert result.grades.count() == 50


def counts(spark, **given):
    values = {"critical": 0, "high": 0, "medium": 0, "low": 0, "info": 0, **given}
    row = [(1, *values.values(), sum(values.values()))]
    return spark.createDataFrame(row, ", ".join(f"{c} bigint" for c in ["target_id", *values, "total"]))


@pytest.mark.parametrize("given, letter", [
    ({}, "A+"), ({"info": 9}, "B+"), ({"medium": 3}, "B+"), ({"medium": 4}, "B-"), ({"high": 1, "medium": 9}, "C"),
    ({"high": 2}, "C"), ({"high": 3}, "D"), ({"critical": 1, "high": 9}, "F"), ({"low": 7}, "B+")])
def test_grade(spark, given, letter):
    assert rollup.grade(counts(spark, **given)).first().grade == letter


def test_bars_are_relative_to_the_largest_count(spark):
    rows = {r.severity: r.bar_len for r in rollup.severity_bars(counts(spark, critical=3, high=7, info=1)).collect()}
    assert rows == {"CRITICAL": 10, "HIGH": 25, "MEDIUM": 0, "LOW": 0, "INFO": 3}
    assert rollup.severity_bars(counts(spark)).agg(F.sum("bar_len")).first()[0] == 0


def test_targets_without_findings_are_counted(spark):
    targets = spark.createDataFrame([(1,), (2,)], "target_id bigint")
    findings = spark.createDataFrame(
        [(1, "m", "t", "HIGH", None, None, 1), (1, "js", "t", "MEDIUM", None, None, 0)],
        "target_id bigint, module string, type string, severity string, location string, evidence string, n_counted bigint")
    rows = {r.target_id: (r.high, r.medium, r.total) for r in rollup.severity_counts(findings, targets).collect()}
    assert rows == {1: (1, 0, 1), 2: (0, 0, 0)}


def test_header_spelling(spark):
    targets = spark.createDataFrame([(1,), (2,)], "target_id bigint")
    rows = spark.createDataFrame(
        [(1, "x-frame-options", "DENY"), (1, "REFERRER-POLICY", "none"), (1, "SERVER", "x"), (1, "server", "y")],
        "target_id bigint, name string, value string")
    audit_rows = {(r.target_id, r.header): (r.status, r.value)
                  for r in headers.header_audit(targets, rows).collect()}
    assert audit_rows[(1, "X-Frame-Options")] == ("PRESENT", "DENY")
    assert audit_rows[(1, "Referrer-Policy")] == ("PRESENT", "")
    assert audit_rows[(2, "X-Frame-Options")] == ("MISSING", None) and len(audit_rows) == 14
    assert [r.value for r in headers.header_info_leak(rows).collect()] == ["y"]


def test_repeated_headers_keep_their_order(spark):
    targets = spark.createDataFrame([(1,)], "target_id bigint")
    rows = spark.createDataFrame(
        [(1, "X-Powered-By", "PHP", 2), (1, "X-Powered-By", "Zend", 1), (1, "X-Powered-By", None, 0), (1, "Referrer-Policy", "b", 1), (1, "Referrer-Policy", "a", 2)],
        "target_id bigint, name string, value string, seq bigint")
    assert [r.value for r in headers.header_info_leak(rows).collect()] == ["Zend, PHP"]
    assert [r.value for r in headers.header_audit(targets, rows).collect() if r.header == "Referrer-Policy"] == ["b, a"]


def test_certificates_of_one_target_stay_apart(spark):
    kinds = "target_id bigint, status string, error string, subject string, version string, serial string, issuer string, not_before string, not_after string, alt_name string, pos bigint"
    one = [(1, "VALID", None, "CN=a", "3", "9", "Z", "x", "y", f"n{n:02}", n) for n in range(12)]
    rows = spark.createDataFrame([*one, *one, (1, "VALID", None, "CN=b", "3", "1", "A", "x", "y", None, None), (2, "ERROR", "late", "?", None, None, None, None, None, None, None)], kinds)
    got = {(r.target_id, r.subject): (r.issuer, r.serial, r.error, r.alt_names) for r in headers.cert_inventory(rows).collect()}
    names = [f"n{n:02}" for n in range(12)]
    assert got == {(1, "CN=a"): ("Z", "9", None, ", ".join(names)), (1, "CN=b"): ("A", "1", None, ""), (2, None): (None, None, "late", None)}
    assert [(r.subject, r.alt_names) for r in headers.cert_report_rows(rows).collect()] == [("CN=a", ", ".join(names[:10]))]
    assert headers.cert_inventory(rows.limit(0)).count() == 0


def test_captured_answers_do_not_pile_up(spark):
    rows = spark.createDataFrame([(1, "A", p + 10 * again, f"v{p}") for p in range(7) for again in range(50)], "target_id bigint, rtype string, pos bigint, value string")
    assert headers.dns_rollup(rows).collect() == [(1, "A", 7, "v0, v1, v2, v3, v4, v5, v6")]
    assert headers.dns_report_rows(rows).collect() == [(1, "A", "v0, v1, v2, v3, v4")]


def test_rolled_up_by_host(spark):
    targets = spark.createDataFrame([(1, "https://A.b/x"), (2, "http://a.b"), (3, "https://c.d")], "target_id bigint, url string")
    counts = spark.createDataFrame([(1, 1, 0, 0, 0, 2, 3), (2, 1, 0, 0, 0, 0, 1), (3, 0, 0, 0, 4, 0, 4)], "target_id bigint, critical bigint, high bigint, medium bigint, low bigint, info bigint, total bigint")
    got = {(r.host, r.severity, r.level): r.n for r in rollup.severity_rollup(counts, targets).collect()}
    assert (got["a.b", "CRITICAL", 0], got["a.b", None, 1], got["c.d", "LOW", 0], got[None, None, 3]) == (2, 4, 4, 8)
    assert len(got) == 10 + 2 + 1


@pytest.mark.parametrize("path, severity", [
    ("/tsconfig.json", "CRITICAL"), ("/.gitignore", "CRITICAL"), ("/Dockerfile", "MEDIUM"), ("/docker-compose.yml", "HIGH"),
    ("/package-lock.json", "MEDIUM"), ("/package.json", "HIGH"), ("/.well-known/security.txt", "INFO"), ("/admin", "MEDIUM")])
def test_path_severity(spark, path, severity):
    assert spark.range(1).select(responses.path_severity(F.lit(path))).first()[0] == severity


def test_cookie_attributes(spark):
    rows = spark.createDataFrame(
        [(1, 5, "https://Shop.example.com/a/b?c", "sid=a=b; Domain=example.com; path=/x; SECURE; httponly; samesite=Lax"),
         (1, 3, "https://Shop.example.com/a/b?c", "sid=old; Domain=example.com; path=/x"),
         (2, 1, "http://h/a/b/c", "k=v; Secured=no")], "target_id bigint, seq bigint, url string, set_cookie string")
    got = {r.target_id: r for r in cookies.cookie_parse(rows).collect()}
    assert (got[1].name, got[1].domain, got[1].path, got[1].secure, got[1].httponly, got[1].samesite) == (
        "sid", ".example.com", "/x", True, True, "Lax")
    assert (got[2].domain, got[2].path, got[2].secure, got[2].httponly, got[2].samesite) == ("h", "/a/b", False, False, "Not Set")
    assert cookies.insecure_cookie_count(cookies.cookie_parse(rows)).orderBy("target_id").collect()[0].n_insecure == 0


def test_jar_like_a_client(spark):
    """Set, deleted, set again, expired and foreign cookies, as the standard library keeps them."""
    from datetime import datetime, timezone
    from email.message import Message
    from http.cookiejar import CookieJar
    from urllib.request import Request

    url = "https://shop.example.com/a/b"
    lines = [
        "k1=a; Path=/", "k2=a; Path=/; Max-Age=0", "k3=a; Path=/", "k3=; Path=/; Max-Age=-5", "k4=a; Path=/", "k4=; Path=/; Max-Age=0", "k4=b; Path=/; Secure",
        "k5=a; Path=/; Expires=Wed, 21 Oct 2015 07:28:00 GMT", "k6=a; Path=/; Expires=Wed, 21-Oct-2099 07:28:00 GMT", "k7=a; Path=/; Domain=example.com",
        "k8=a; Path=/; Domain=other.com", "k9=a; Path=/; Domain=ample.com", "k10=a; Path=/; Expires=Wed, 21 Oct 2015 07:28:00 GMT; Max-Age=60", "k11=a; Path=/; Expires=soon",
    ]

    class Answer:
        def __init__(self, line):
            self.message = Message()
            self.message["Set-Cookie"] = line

        def info(self):
            return self.message

    jar = CookieJar()
    for line in lines:  # an answer each, as the library deletes before it sets those of one answer
        jar.extract_cookies(Answer(line), Request(url))
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(1, n, url, line, now) for n, line in enumerate(lines)], "target_id bigint, seq bigint, url string, set_cookie string, captured_at timestamp")
    got = {r.name: (r.path, r.secure) for r in cookies.cookie_parse(rows).collect()}
    assert got == {c.name: (c.path, c.secure) for c in jar}
    assert {r.name for r in cookies.cookie_parse(rows.drop("captured_at")).collect()} == set(got) | {"k5"}


def test_script_findings_first_wins_and_cap(spark):
    text = "".join(f"fetch('https://h/{n}');" for n in range(3)) + "eval(1);eval(2)"
    rows = [(1, n, f"u{n}", text) for n in range(40)] + [(2, 0, "inline", text), (2, 1, "inline", text)]
    scripts = spark.createDataFrame(rows, "target_id bigint, seq bigint, url string, content string")
    got = javascript.js_dedup(javascript.js_findings(scripts))
    assert got.filter("target_id = 1").count() == 80
    assert javascript.js_dedup(javascript.js_findings(scripts), limit=50).filter("target_id = 1").count() == 50
    assert [(r.pattern, r.context) for r in got.filter("target_id = 2").orderBy("seq", "ord").collect()][1] == ("API Endpoint", "https://h/0")
    assert got.filter("target_id = 2").count() == 2


def test_tool_reports_survive_bad_lines(spark):
    lines = [(1, "wp", "{\"target\":1,\"vulnerabilities\":[{},{\"title\":\"T\",\"references\":{\"url\":[]}}]}"), (1, "wp", "{broken"),
             (2, "wp", "{\"target\":null,\"plugins\":{\"p\":{\"vulnerabilities\":[{}]}}}"), (3, "wp", ""), (4, "git", "[{}]"), (5, "git", "{}")]
    rows = spark.createDataFrame(lines, "target_id bigint, tool string, line string")
    got = sorted((r.target_id, r.name, r.description) for r in tool_reports.wp_report_findings(rows).collect())
    assert got == [(1, "T", " | Ref: N/A"), (1, "Unknown", " | Ref: N/A"), (2, "Plugin: p - vuln", "")]
    assert [r.target_id for r in tool_reports.wp_report_clean(rows, tool_reports.wp_report_findings(rows)).collect()] == [3]
    assert [(r.name, r.description) for r in tool_reports.git_report_findings(rows).collect()] == [
        ("Secret Found", "File: unknown, Line: ?")]
    assert sorted(r.target_id for r in tool_reports.unreadable_lines(rows).collect()) == [1, 3, 5]


def test_findings_are_written_by_severity(spark):
    rows = sec.secret_findings(page_resources(relation(spark, SMALL, "planted_pages")))
    path = folder()
    sinks.write_findings(rows, path)
    assert {p.name for p in Path(path).iterdir() if p.is_dir()} == {f"severity={s}" for s in ("CRITICAL", "HIGH", "MEDIUM")}
    assert spark.read.parquet(path).count() == rows.count()


def test_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context

    class Unset:
        get = staticmethod(lambda key, default=None: default)

    Session.conf = Unset
    with pytest.raises(ValueError):
        sinks.shared_folder(Session)
    assert sinks.shared_folder(Session, "s3a://b/c").startswith("s3a://b/c/run-")


def stream_rows(spark, path):
    files = spark.readStream.schema("page_id bigint, url string, html string").parquet(path)
    planted = planted_html(files).withColumn("captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    return page_resources(planted, "captured_at")


COLUMNS = ["target_id", "type", "value_masked", "location", "context", "severity", "n_values"]


def test_stream_equals_batch_and_continues(spark, few_partitions):
    pages = read_table(spark, SMALL, "pages")
    source, out, progress = folder(), folder(), folder()
    pages.filter("page_id < 25").write.parquet(source)
    scan.drain(scan.scan_stream(stream_rows(spark, source), "1 day"), out, progress)
    pages.filter("page_id >= 20").write.mode("append").parquet(source)  # pages 20..24 arrive again
    scan.drain(scan.scan_stream(stream_rows(spark, source), "1 day"), out, progress)
    batch = sec.secret_findings(page_resources(relation(spark, SMALL, "planted_pages"))).select(COLUMNS)
    got = scan.present(spark, out).select(COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


@pytest.fixture
def few_partitions(spark):
    """One Python worker per state partition: two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def drained(spark, rows, *delays):
    """The rows as one file and one micro-batch each, through the scan."""
    source, out = folder(), folder()
    for row in rows:
        spark.createDataFrame([row], SHAPE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(source)
    scan.drain(scan.scan_stream(stream, *delays), out, folder())
    return out


SHAPE = "target_id bigint, seq bigint, kind string, url string, content string, captured_at timestamp"


def arrivals():
    """Two values with one mask, one of them in a script and a style sheet too, and a suppressed place; one file each."""
    at = lambda n: datetime(2024, 1, 1, 0, 0, n, tzinfo=timezone.utc)
    return [
        (1, 0, "html", "HTML page", "a redis://pass1@h/1 b", at(5)),
        (1, 1, "js", "x.js", f"q {TOKEN['a']} redis://pass2@h/1 redis://pass1@h/1", at(1)),
        (1, 2, "css", "s.css", "csrf redis://pass2@h/1", at(3)),
        (2, 0, "html", "HTML page", "c redis://pass1@h/1 redis://pass1@h/1", at(2)),
        (1, 3, "js", "y.js", f"redis://pass3@h/1 {TOKEN['a']}", at(4)),
    ]


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0)])
def test_stream_in_any_order_equals_batch(spark, few_partitions, order):
    rows = arrivals()
    out = drained(spark, [rows[n] for n in order], "1 day")
    batch = sec.secret_findings(spark.createDataFrame(rows, SHAPE).drop("captured_at")).select(COLUMNS).collect()
    got = scan.present(spark, out).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    assert {r.n_values for r in got} == {1, 3} and scan.late(spark, out).count() == 0


def test_late_rows_are_counted_and_old_state_goes(spark, few_partitions):
    at = lambda minute: datetime(2024, 1, 1, 0, minute, tzinfo=timezone.utc)
    rows = [(1, 0, "html", "HTML page", f"q {TOKEN['a']}", at(1)), (2, 0, "html", "HTML page", "nothing", at(50)), (3, 0, "html", "HTML page", "nothing", at(51)),
            (1, 1, "js", "late.js", f"q {TOKEN['b']} {TOKEN['a']}", at(2)), (1, 2, "js", "new.js", f"q {TOKEN['a']}", at(55))]
    out = drained(spark, rows, "10 minutes", "5 minutes")
    late = [(r.target_id, r.value_masked[6:9], r.location) for r in scan.late(spark, out).collect()]
    assert sorted(late) == [(1, "aaa", "late.js"), (1, "bbb", "late.js")]
    # The first finding was forgotten after five minutes, so the script that came in time begins a new one.
    got = scan.present(spark, out).collect()
    assert [(r.target_id, r.location, r.version) for r in got] == [(1, "new.js", 1)]


def test_replayed_batch_leaves_the_same_files(spark):
    out, write = folder(), None
    rows = spark.createDataFrame([(n, "T", f"m{n}", "HIGH" if n % 2 else "MEDIUM") for n in range(40)], "target_id long, type string, value_masked string, severity string")
    files = lambda: {str(p.relative_to(out)) for p in Path(out).rglob("*.parquet")}
    write = sinks.batch_writer(out)
    write(rows, 0)
    write(rows.filter("target_id < 10"), 1)
    assert {p.name for p in Path(f"{out}/findings").iterdir() if p.is_dir()} == {"severity=HIGH", "severity=MEDIUM"}
    before = files()
    write(rows, 0)  # the ledger knows it
    assert files() == before and sinks.read_batches(spark, out).count() == 50
    sinks.delete(spark, f"{out}/ledger/batch=1")  # as if the writer had died before its last step
    assert sinks.read_batches(spark, out).count() == 40
    write(rows.filter("target_id < 10"), 1)
    assert sinks.read_batches(spark, out).count() == 50 and len(files()) == len(before)
    write(rows.limit(0), 2)
    assert sinks.read_batches(spark, out).count() == 50


def test_stream_windows(spark):
    source = folder()
    read_table(spark, SMALL, "pages").write.parquet(source)
    found = scan.value_stream(stream_rows(spark, source), "2 seconds")
    query = (scan.severity_windows(found, "10 seconds").writeStream.format("memory").queryName("severity_windows")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    written = folder()
    scan.drain(found, written, folder())
    findings = sinks.read_batches(spark, written)
    expected = scan.severity_windows(findings, "10 seconds")
    # Windows that the watermark has passed are final; the last one is still open.
    passed = findings.agg(F.expr("max(captured_at) - INTERVAL 2 SECONDS")).first()[0]
    closed = {tuple(r) for r in expected.filter(F.col("start") + F.expr("INTERVAL 10 SECONDS") <= F.lit(passed)).collect()}
    assert closed and {tuple(r) for r in spark.table("severity_windows").collect()} == closed
    assert expected.agg(F.sum("n")).first()[0] == findings.count()
