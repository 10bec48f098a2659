"""Addresses, page structure, words and fingerprints against the standard library."""

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from checks.fixtures import relation
from sitewarden.functions import matching, urls
from sitewarden.functions.words import MARK, WordIndex
from sitewarden.operators import acquisition as acq
from sitewarden.operators import fingerprint, forms, leaks
from sitewarden.rules import builders, tech
from tests.conftest import SMALL

BASES = ["https://a.example.com/x/y/z.html?q=1#f", "http://a.example.com", "https://a.example.com:8080/d/"]
REFS = ["b.js", "/b.js", "//cdn.example.com/b.js", "https://c.example.com/b.js", "../b.js", "./b.js", "../../../b.js",
        "d/./e/../f.js", "?v=2", "#top", "/a/../b.js?x=../y", "data:text/css,p", "b.js?u=http://z/", "..", "e/.."]


def test_resolve_like_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    got = spark.createDataFrame(rows, "b string, r string").select(
        "b", "r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()
    assert {(g.b, g.r): g.u for g in got} == {(b, r): urljoin(b, r) for b, r in rows}


def test_parts_like_the_standard_library(spark):
    addresses = [*BASES, "HTTPS://User:pw@Host.Example.COM:443/p", "https://[2001:db8::1]:80/", "ftp://h"]
    rows = acq.url_parts(spark.createDataFrame([(a,) for a in addresses], "url string")).collect()
    for r in rows:
        parsed = urlparse(r.url)
        assert (r.scheme, r.host, r.netloc) == (parsed.scheme, parsed.hostname, parsed.netloc)


@pytest.mark.parametrize("raw, expected", [
    ("  example.com// ", "https://example.com"), ("HTTP://x.com/", "HTTP://x.com"), ("", ""), (" \t", ""),
    ("ftp://x", "https://ftp://x"), ("https://x.com/a/", "https://x.com/a")])
def test_normalize(spark, raw, expected):
    df = acq.target_normalize(spark.createDataFrame([(raw,)], "url string"))
    assert df.first().normalized == expected


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.forms, self.scripts, self.metas, self._inside = [], [], [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "form":
            self.forms.append((a.get("action") or "", (a.get("method") or "GET").upper(), []))
        elif tag == "input" and self.forms:
            self.forms[-1][2].append((a.get("name") or "", a.get("type", "text") or "", a.get("id") or ""))
        elif tag == "meta" and (a.get("name", a.get("property")) or ""):
            self.metas.append((a.get("name", a.get("property")), a.get("content") or ""))
        elif tag == "script":
            self._inside = a

    def handle_data(self, data):
        if self._inside is not None and not self._inside.get("src"):
            self.scripts.append(data)

    def handle_endtag(self, tag):
        if tag == "script":
            self._inside = None


TRICKY = [
    "<!-- <form action=x><script src=a.js></script></form> --><script>var a='<form>';</script>",
    "<form data-action='no' ACTION = '/a&amp;b?x=\"1\"' method=Post><input name=\"a>b\" type=hidden><INPUT id=i /></form>",
    "<script type='x' src = b.js ></script><script>if(a<b){c=\"</p>\"}</script><meta property=og:t content='a > b'>",
    "<meta name=\"generator\" content=\"WordPress 6\"><meta charset=utf-8><meta name=x>",
    "<formula action=z></formula><p title='<form>'>q</p>",
]


def parsed(text):
    reader = Reader()
    reader.feed(text)
    reader.close()
    return reader


@pytest.mark.parametrize("source", ["tricky", "planted"])
def test_structure_like_the_html_parser(spark, pages, source):
    given = pages(TRICKY) if source == "tricky" else relation(spark, SMALL, "planted_pages")
    texts = {r.page_id: parsed(r.html) for r in given.collect()}
    if source == "tricky":
        given, texts = given.filter("page_id < 4"), {k: v for k, v in texts.items() if k < 4}
    mine = {}
    for r in forms.form_extract(forms.page_forms(given)).orderBy("target_id", "form_no", "input_no").collect():
        entry = mine.setdefault(r.target_id, {}).setdefault(r.form_no, (r.action, r.method, []))
        if r.input_no:
            entry[2].append((r.input_name, r.input_type, r.input_id))
    assert {k: list(v.values()) for k, v in mine.items()} == {k: v.forms for k, v in texts.items() if v.forms}
    scripts = {}
    for r in acq.inline_resources(acq.resource_extract(given)).filter("kind = 'js'").orderBy("target_id", "seq").collect():
        scripts.setdefault(r.target_id, []).append(r.content)
    assert scripts == {k: v.scripts for k, v in texts.items() if v.scripts}
    metas = {}
    for r in fingerprint.page_metas(given).orderBy("target_id", "pos").collect():
        metas.setdefault(r.target_id, []).append((r.name, r.content))
    assert metas == {k: v.metas for k, v in texts.items() if v.metas}


def test_words_with_and_without_automaton(spark):
    pages = relation(spark, SMALL, "planted_pages").withColumn(
        "html", F.when(F.col("page_id") == 3, None).when(F.col("page_id") == 4, "").otherwise(F.col("html")))
    words = matching.WORDS

    def marks(automaton):
        return {r.page_id: r[MARK] for r in words.mark(pages, "html", automaton).select("page_id", MARK).collect()}

    assert marks(True) == marks(False)


def test_word_index_masks(spark):
    index = WordIndex([f"w{i:03d}x" for i in range(150)])
    rows = index.mark(spark.createDataFrame([("W000X and w149x",), ("w061x w062x",)], "t string"), "t")
    test = rows.select(*[F.expr(index.present([f"w{i:03d}x"])) for i in range(150)]).collect()
    assert [[i for i, v in enumerate(r) if v] for r in test] == [[0, 149], [61, 62]]


def sample(pattern):
    """A text for a fingerprint: operators replaced by one of their readings."""
    text = re.sub(r"\(\?:([^)|]*)[^)]*\)\??", r"\1", pattern)
    text = text.replace(r"\d{4,}-\d{1,}", "1234-5").replace("[A-Z0-9]+", "AB12").replace(".*?", " z ").replace(".*", " z ")
    return re.sub(r"\\(.)", r"\1", text)


SIGNATURES = [*tech.SIGNATURES.items(), *builders.SIGNATURES.items()]


def test_every_fingerprint_fires(spark):
    rows = [(n, p, sample(p)) for n, p in enumerate(p for _, ps in SIGNATURES for p in ps)]
    for _, pattern, text in rows:
        assert re.search(pattern, text, re.I), (pattern, text)
    texts = spark.createDataFrame([(n, 0, t.upper()) for n, _, t in rows], "target_id bigint, source int, text string")
    marked = matching.WORDS.mark(texts, "text")
    hits = marked.select("target_id", *[F.expr(matching.signature_test("text", p)).alias(f"p{n}") for n, p, _ in rows])
    for row in hits.collect():
        pattern_no = row.target_id
        assert row[f"p{pattern_no}"], rows[pattern_no]
        for n, pattern, _ in rows:
            assert row[f"p{n}"] == bool(re.search(pattern, rows[pattern_no][2].upper(), re.I)), (pattern, rows[pattern_no])


def test_line_span_needs_one_line_and_order(spark):
    texts = ["x class=\"a\n flex", "flex class=\"", "class=\"q\" class=\"flex", "CLASS=\"w-1"]
    df = spark.createDataFrame([(n, 0, t) for n, t in enumerate(texts)], "target_id bigint, source int, text string")
    got = fingerprint.tech_detect(df).filter("technology = 'Tailwind CSS'").collect()
    assert sorted(r.target_id for r in got) == [2, 3]


def test_builder_takes_the_first_fingerprint_of_the_list(spark):
    df = spark.createDataFrame([(1, 0, "x gptengineer y data-lovable"), (1, 2, "https://lovable.dev/p")],
                               "target_id bigint, source int, text string")
    row = fingerprint.builder_detect(df).collect()
    assert [(r.tool, r.matched_pattern, r.evidence) for r in row] == [
        ("Lovable (GPT Engineer)", r"lovable\.dev", "https://lovable.dev/p")]


def test_repositories_and_later_metas(pages):
    given = pages([" ".join(f"github.com/o/r{n}" for n in (5, 1, 3, 2, 1)) + "<meta name=a content=1><meta name=a content=2>"])
    assert [r.repo for r in fingerprint.repo_links(given).orderBy("repo").collect()] == [f"github.com/o/r{n}" for n in (1, 2, 3, 5)]
    assert [(r.name, r.content) for r in fingerprint.meta_extract(fingerprint.page_metas(given)).collect()] == [("a", "2")]


def test_config_and_comments(pages):
    given = pages([
        "<script>window.__NUXT__ = {config:{baseUrl:\"https://b\",NODE_ENV:'prod', STRIPE_PMC_KEY_LIVE : \"k\"}}</script>",
        "<!-- api --><!-- todo: api key --><!--[if IE]> token --><!-- plain words -->",
    ])
    keys = {(r.type, r.content, r.severity) for r in leaks.framework_config_keys(given).collect()}
    assert keys == {
        ("Framework Config Leak — Nuxt.js Runtime Config", "STRIPE_PMC_KEY_LIVE: k", "HIGH"),
        ("Framework Config Exposed — Nuxt.js Runtime Config",
         "Runtime config object injected in HTML exposes: baseUrl=https://b | NODE_ENV=prod | STRIPE_PMC_KEY_LIVE=k", "MEDIUM"),
    }
    assert [r.content for r in leaks.comment_leak(given).collect()] == ["todo: api key"]
