"""Credential rules, context rules, cap, mask, order."""

import re

import pytest
from pyspark.sql import functions as F

from checks.fixtures import POSITIVES, relation
from sitewarden.operators import secrets as sec
from sitewarden.rules import false_positives as fp
from sitewarden.rules import secrets as rules
from sitewarden.sources.captured import page_resources
from tests.conftest import SMALL

PAD = " . " * 40
HEX = "0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def positives(spark):
    """Rule -> text that matches it."""
    row = spark.sql(
        "SELECT " + ", ".join(f"{sql} AS p{n}" for n, sql in enumerate(POSITIVES))
        + " FROM (SELECT md5('7') AS h, 7L AS page_id)"
    ).first()
    return dict(zip(rules.PATTERNS, row))


def found(df):
    return sorted((r.target_id, r.rule, r.value) for r in df.select("target_id", "rule", "value").collect())


def test_each_rule_matches_its_positive(resources, positives):
    texts = [f"<i>{v}</i>" for v in positives.values()]
    rows = found(sec.secret_matches(resources(texts)))
    for n, rule in enumerate(rules.PATTERNS):
        assert any(t == n and r == rule for t, r, _ in rows), rule


def test_near_misses_do_not_match(resources, positives):
    """One character short of the needed length."""
    fixed = [r for r in ("AWS Access Key", "Stripe Secret Key", "OpenAI API Key", "Google API Key", "Twilio API Key",
                         "GitLab Token", "Shopify API", "DigitalOcean Token", "Square Access Token", "Mailgun API Key")]
    lengths = {"OpenAI API Key": 34, "GitLab Token": 25}
    texts = [f"<i>{positives[r][:lengths.get(r, len(positives[r]) - 1)]}</i>" for r in fixed]
    rows = found(sec.secret_matches(resources(texts)))
    for n, rule in enumerate(fixed):
        assert not any(t == n and r == rule for t, r, _ in rows), rule


def test_counts_equal_plain_regular_expressions(spark):
    pages = relation(spark, SMALL, "planted_pages")
    mine = {(r.target_id, r.rule): r["n"] for r in sec.secret_matches(page_resources(pages))
            .groupBy("target_id", "rule").agg(F.count("*").alias("n")).collect()}
    theirs = {}
    for row in pages.collect():
        for rule, pattern in rules.PATTERNS.items():
            n = len(list(re.finditer(pattern, row.html)))
            if n:
                theirs[(row.page_id, rule)] = n
    assert mine == theirs


def test_words_decide_nothing_but_the_work(spark):
    rows = page_resources(relation(spark, SMALL, "planted_pages"))
    assert found(sec.secret_matches(rows)) == found(sec.secret_matches(rows, gated=False))


def test_context_is_eighty_characters_around(resources):
    value = "glpat-" + "a" * 20
    text = "é" * 100 + "\n" + "<b>" + value + "</b>" + "x" * 100 + value
    rows = sec.secret_matches(resources([text])).orderBy("pos").select("value", "context").collect()
    starts = [m.start() for m in re.finditer(re.escape(value), text)]
    assert [r.value for r in rows] == [value]
    start = starts[0]
    expected = text[max(0, start - 80):start + len(value) + 80].replace("\n", " ").strip()
    assert rows[0].context == expected


@pytest.mark.parametrize("between", [",", " - ", "\n" * 30, "x" * 79 + " ", " " * 81])
@pytest.mark.parametrize("keep", [None, 51])
def test_context_of_close_and_short_matches(resources, between, keep):
    text = between.join(f"ya29.{'é' if n % 7 == 0 else n}" if n % 5 else "ya29." + "k" * 90 for n in range(60))
    pattern = rules.PATTERNS["Google OAuth Token"]
    expected = [(m[0], text[max(0, m.start() - 80):m.end() + 80].replace("\n", " ").strip())
                for m in re.finditer(pattern, text, re.A)][:keep]
    rows = sec.secret_matches(resources([text]), keep=keep).orderBy("pos").collect()
    assert [(r.value, r.context) for r in rows if r.rule == "Google OAuth Token"] == expected
    assert min(len(m) for m, _ in expected) >= rules.SHORTEST_MATCH


@pytest.mark.parametrize("n, kept", [(50, 50), (51, 0), (400, 0)])
def test_cap_counts_all_resources_of_a_target(resources, n, kept):
    half = n // 2
    rows = [(1, "html", "HTML page", " ".join(f"10.0.0.{i % 200}" for i in range(half))),
            (1, "js", "inline", " ".join(f"10.1.0.{i % 200}" for i in range(n - half)))]
    assert sec.apply_cap(sec.secret_matches(resources(rows))).count() == kept


def test_cap_with_a_hot_target_spread_over_many_resources(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("target_id"),
        F.col("id").alias("seq"), F.lit("js").alias("kind"), F.concat(F.lit("u"), "id").alias("url"),
        F.concat(F.lit("<i>10.0.0."), F.col("id") % 250, F.lit("</i>")).alias("content"),
    )
    left = sec.apply_cap(sec.secret_matches(rows))
    assert left.count() == 2000 and left.filter("target_id = 0").count() == 0


GENERIC = "client_secret = 'abcdefgh12345678'"
CASES = [
    ("F1", "IP Address (Private)", "version 10.1.2.3", "host 10.1.2.3"),
    ("F2", "JWT Token", f"font eyJ{HEX}.eyJ{HEX}.{HEX}", f"x eyJ{HEX}.eyJ{HEX}.{HEX}"),
    ("F3", "Google API Key", "AIza" + "EXAMPLE" + HEX[:28], "AIza" + HEX + "abc"),
    ("F4", "Generic Secret", "client_secret = 'my-email-value'", GENERIC),
    ("F5", "Generic Secret", "access_token='access_token' " + GENERIC, GENERIC),
    ("F6", "Generic Secret", "password: 'short-one' " + GENERIC, "password: '" + "a" * 31 + "'"),
    ("F7", "Generic Secret", "username='%filtered%' " + GENERIC, "username='plain' " + GENERIC),
    ("F8", "Generic Secret", "statsigClientApiKey " + GENERIC, "statsig " + GENERIC),
    ("F9", "Generic Secret", "apiKey: '" + "a" * 20 + "'", "apiKey: '" + "a" * 19 + "'"),
    ("F10", "Generic Secret", "API_KEY = \"invalid-api_key\" " + GENERIC, "API_KEY = 'invalid-api_key' "),
    ("F11", "Generic Secret", "x=\"%filtered%\" " + GENERIC, "x=%filtered% " + GENERIC),
    ("F12", "Generic Secret", "password=\"abcdefgh1\"", "password='abcdefgh1'"),
    ("F13", "Generic Secret", "MY RESET_PASSWORD=\"/reset\" " + GENERIC, "RESET_PASSWORD='/r' " + GENERIC),
    ("F14", "Generic Secret", "ApiKey=\"some_value1\"", "ApiKey='some_value1'"),
]


@pytest.mark.parametrize("number, rule, bad, good", CASES, ids=[c[0] for c in CASES])
def test_context_rules(resources, number, rule, bad, good):
    judged = sec.judge(sec.secret_matches(resources([f"<i>{bad}</i>", f"<i>{good}</i>"])), strict=True)
    reasons = {r.target_id: r.suppressed_by for r in judged.filter(F.col("rule") == rule).collect()}
    expected = {"F7": ("F7", "F11"), "F13": ("F12", "F13")}.get(number, (number,))
    assert reasons[0] in expected
    assert reasons.get(1, "absent") is None


@pytest.mark.parametrize("word", ["--token-", "--color-", "--font-", "var(--", "csrf", "nonce=", "integrity=",
                                  "data:image/", "sourceMappingURL", ".woff", ".ttf", "apbct-", "cleantalk", "poptin"])
def test_global_context(resources, word):
    assert len(fp.GLOBAL_CONTEXT) == 14
    near, far = f"{word.upper()} glpat-{'a' * 20}", f"{word}{' ' * 90}glpat-{'a' * 20}"
    assert [r.target_id for r in sec.judge(sec.secret_matches(resources([near, far]))).collect()] == [1]


def test_values_leave_only_masked(resources):
    value = "glpat-" + "0123456789" * 2
    rows = sec.secret_findings(resources([f"<b>{value}</b>", "<i>10.1.2.3</i>"])).orderBy("target_id").collect()
    assert rows[0].value_masked == value[:12] + "..." + value[-6:]
    assert rows[1].value_masked == "10.1.2****"
    assert value not in rows[0].context and "10.1.2.3" not in rows[1].context


def test_location_prefers_styles_then_scripts(resources):
    token = "glpat-" + "b" * 20
    rows = resources([(1, "html", "HTML page", token), (1, "js", "https://x/a.js", token), (1, "css", "https://x/a.css", token),
                      (2, "html", "HTML page", token), (2, "js", "inline", token), (3, "html", "HTML page", token)])
    assert {r.target_id: r.location for r in sec.secret_findings(rows).collect()} == {
        1: "https://x/a.css", 2: "inline", 3: "HTML page"}


def test_result_does_not_depend_on_partitions(spark):
    rows = page_resources(relation(spark, SMALL, "planted_pages"))
    expected = sorted(map(tuple, sec.secret_findings(rows).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, spread in (("1", 1), ("13", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert sorted(map(tuple, sec.secret_findings(rows.repartition(spread, "target_id")).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_dedup_is_idempotent(spark):
    matches = sec.to_findings(sec.secret_matches(page_resources(relation(spark, SMALL, "planted_pages"))))
    once = sec.dedup(matches)
    assert sorted(map(tuple, sec.dedup(once).collect())) == sorted(map(tuple, once.collect()))


def test_only_line_feeds_end_a_line(resources):
    paypal = "paypal\rclient_id='" + "a" * 20 + "'"
    other = "paypal\nclient_id='" + "a" * 20 + "'"
    rows = found(sec.secret_matches(resources([paypal, other])))
    assert [t for t, r, _ in rows if r == "PayPal Client ID"] == [0]


AWS, LAB = "AKIA" + "Q7ZK2M4N5P6R7S8T", "glpat-" + "aB3dE5fG7hJ9kL2mN4pQ"


def test_no_raw_neighbour_in_a_context(resources):
    rows = sec.secret_findings(resources([f"<i>{AWS}</i> <b>{LAB}</b> 10.1.2.3"])).collect()
    assert len(rows) >= 3
    assert not any(v in r.context for r in rows for v in (AWS, LAB, "10.1.2.3"))


def test_a_cut_neighbour_is_hidden(resources):
    text = f"{LAB} " + "x " * 35 + AWS + " y" * 35 + f" {LAB}"
    [row] = [r for r in sec.secret_findings(resources([text])).collect() if r.type.startswith("AWS")]
    assert not any(LAB[i : i + 10] in row.context for i in range(len(LAB) - 9))


def test_all_matches_without_a_cap(resources):
    text = " ".join(f"<i>10.{n // 250}.{n % 250}.7</i>" for n in range(400))
    values = sec.secret_values(sec.secret_matches(resources([text])))
    assert values.count() == 400
    assert sum(r.n_values for r in sec.secret_findings(resources([text])).collect()) == 400
    assert sec.secret_findings(resources([text]), cap=50).count() == 0


def test_location_is_that_of_the_value(resources):
    rows = resources([(1, "html", "HTML page", "<i>10.0.0.7</i>"), (1, "css", "m.css", "/* <i>10.0.0.9</i> */")])
    [row] = sec.secret_findings(rows).collect()
    assert (row.location, row.n_values) == ("HTML page", 2)
    assert {(r.value_masked, r.location) for r in sec.secret_locations(sec.secret_matches(rows)).collect()} == {("10.0.0****", "HTML page"), ("10.0.0****", "m.css")}


def test_rotated_values_with_one_mask_are_historical(resources):
    live, old = (sec.secret_matches(resources([f"<i>redis://{w}pass@h/1</i>"])) for w in ("new", "old"))
    assert [r.value_masked for r in sec.historical_only(live, old).collect()] == ["redis:****"]
    assert sec.historical_only(live, live).count() == 0


def test_rule_tables_are_as_reviewed():
    import hashlib

    from sitewarden.rules import builders, tech

    tables = (rules.PATTERNS, tech.SIGNATURES, builders.SIGNATURES)
    assert [len(t) for t in tables] == [42, len(tech.SIGNATURES), len(builders.SIGNATURES)]
    assert hashlib.sha256(repr([list(t.items()) for t in tables]).encode()).hexdigest()[:16] == "6ee1eb41bf8214d9"


def test_first_characters_take_no_match_away():
    """Every alternative that a rule begins with passes the test of its first three characters."""
    starts = {
        "Generic Secret": ["secret_key", "password", "passwd", "api_key", "apikey", "api-key", "auth_token", "access_token", "private_key", "client_secret"],
        "Database URL": ["mysql", "postgres", "postgresql", "mongodb", "redis", "amqp"],
        "IP Address (Private)": ["10.0.0.1", "172.16.0.1", "172.29.0.1", "172.31.0.1", "192.168.0.1"],
        "Base64 Encoded Secret": ["secret", "password", "api_key", "apikey", "auth_token", "access_token", "client_secret"],
    }
    assert set(starts) == set(rules.FIRST)
    ends = {"Generic Secret": " = 'abcd1234'", "Database URL": "://u:p@h/x", "IP Address (Private)": "", "Base64 Encoded Secret": ": " + "Ab" * 30 + "=="}
    for rule, words in starts.items():
        for word in words:
            for shown in (word, word.upper(), word.title()) if rules.PATTERNS[rule].startswith("(?i)") else (word,):
                text = f"a {shown}{ends[rule]} {shown} b{shown}{ends[rule]}"
                plain = [m.group() for m in re.finditer(rules.PATTERNS[rule], text, re.ASCII)]
                assert plain and [m.group() for m in re.finditer(rules.searched(rule), text, re.ASCII)] == plain


def test_scan_looks_for_few_first_characters(resources):
    text = "x password = 'abcd1234' PASSWD=\"efgh5678\" redis://u:p@h/1 10.1.2.3 172.20.1.1 api_key=" + "Ab" * 30
    found = sec.secret_matches(resources([text])).select("rule", "value").collect()
    assert {(r.rule, r.value[:6]) for r in found} == {
        ("Generic Secret", "passwo"), ("Generic Secret", "PASSWD"), ("Database URL", "redis:"), ("IP Address (Private)", "10.1.2"),
        ("IP Address (Private)", "172.20"), ("Base64 Encoded Secret", "api_ke")}
