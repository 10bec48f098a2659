"""Discovered resources, hidden credentials, gated reports."""

import tempfile

import pytest
from pyspark.sql import functions as F

from checks.fixtures import relation
from sitewarden.operators import frontier
from sitewarden.plans import audit
from sitewarden.sources import sinks
from sitewarden.sources.captured import read_table
from tests.conftest import SMALL


def folder():
    return f"{tempfile.mkdtemp(prefix='sitewarden-test-')}/run"


ROOT = "https://s.example.com"


@pytest.mark.parametrize("steps, names", [
    (1, {"a.js": 1, "_buildManifest.js": 1, "c.js": 1}),
    (2, {"a.js": 1, "_buildManifest.js": 1, "c.js": 1, "two.js": 2, "in.js": 2, "k.css": 2}),
    (3, {"a.js": 1, "_buildManifest.js": 1, "c.js": 1, "two.js": 2, "in.js": 2, "k.css": 2, "three.js": 3}),
    (9, {"a.js": 1, "_buildManifest.js": 1, "c.js": 1, "two.js": 2, "in.js": 2, "k.css": 2, "three.js": 3, "four.js": 4}),
])
def test_steps(spark, steps, names):
    static = "/_next/static/chunks/"
    bodies = [("/a.js", [static + "two.js", static + "in.js"], None), ("/m/_buildManifest.js", None, ["/c.js", "/a.js"]), ("/c.js", ["/static/css/k.css"], None),
              (static + "two.js", [static + "three.js", "/a.js"], None), ("/static/css/k.css", [static + "never.js"], None),
              (static + "three.js", [static + "four.js", static + "two.js"], None), (static + "four.js", [static + "three.js"], None)]
    bodies = spark.createDataFrame([(1, ROOT + u, r, p) for u, r, p in bodies], "target_id long, url string, refs array<string>, paths array<string>")
    linked = spark.createDataFrame([(1, ROOT + "/a.js", "js"), (1, ROOT + "/a.js", "js"), (1, ROOT + "/m/_buildManifest.js", "js")], "target_id long, url string, kind string")
    named = spark.createDataFrame([(1, [static + "in.js"])], "target_id long, refs array<string>")
    sites = spark.createDataFrame([(1, ROOT)], "target_id long, base string")
    found = frontier.discover(linked, named, bodies, sites, folder(), steps).collect()
    assert {r.url.rsplit("/", 1)[1]: r.step for r in found} == names and len(found) == len(names)
    assert {r.kind for r in found if r.url.endswith(".css")} <= {"css"}
    known = spark.createDataFrame([(1, f"{ROOT}{static}two.js")], "target_id long, url string")
    assert not any("two.js" in r.url for r in frontier.discover(linked, named, bodies, sites, folder(), steps, known).collect())


def captured(spark):
    pages = relation(spark, SMALL, "planted_pages")
    tables = ["page_meta", "http_header", "set_cookie", "http_response", "resource_body", "archive_index", "tool_report", "cert", "dns_record", "whois"]
    return audit.Captured(pages=pages, scripts=relation(spark, SMALL, "resource_js"), **{t: relation(spark, SMALL, t) for t in tables})


def test_no_credential_reaches_the_sink(spark):
    given = captured(spark)
    tokens = [f"glpat-{c * 20}" for c in "abcdefg"]
    n = 0
    given.pages = given.pages.withColumn("html", F.concat("html", F.lit(f"<!-- debug password {tokens[0]} --><p>built with lovable.dev {tokens[1]}</p>")))
    given.http_header = given.http_header.withColumn("value", F.concat("value", F.lit(f" {tokens[2]}")))
    given.http_response = given.http_response.withColumn("body", F.when(F.col("path") == "/.env", F.concat("body", F.lit(f"\nTOKEN={tokens[3]}"))).otherwise(F.col("body")))
    given.scripts = given.scripts.withColumn("content", F.concat("content", F.lit(f"; eval('{tokens[4]}'); fetch('https://h/{tokens[5]}')")))
    given.tool_report = given.tool_report.withColumn("line", F.regexp_replace("line", '"d"', f'"{tokens[6]}"'))
    result = audit.run(given, folder())
    out = folder()
    sinks.write_findings(result.findings, out)
    rows = [" ".join(map(str, r)) for r in spark.read.parquet(out).collect()]
    for token in tokens:
        assert not [r for r in rows if token in r or token[:22] in r]
        n += 1
    raw = [r.v for r in relation(spark, SMALL, "planted_pages").select(F.regexp_extract("html", "glpat-[0-9a-f]{20}", 0).alias("v")).distinct().collect() if r.v]
    assert raw and n == 7 and not [r for r in rows if any(v in r for v in raw)]
    assert any("****" in r for r in rows)


def test_reports_count_where_their_subject_was_seen(spark):
    given = captured(spark)
    result = audit.run(given, folder())
    flagged = {r.target_id for r in result.tables["wordpress"].filter("wordpress").collect()}
    wp = result.modules["wp"].collect()
    assert wp and {r.target_id for r in wp} <= flagged and all(r.url for r in wp)
    git = result.modules["git"].collect()
    assert git and all(r.url.startswith("https://github.com/") for r in git)
    assert set(result.tables) == {"inventory", "meta", "wordpress", "certificates", "dns", "whois"}
    assert result.tables["inventory"].count() == read_table(spark, SMALL, "pages").count()
