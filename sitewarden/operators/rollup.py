"""Common findings table, counts, grade, advice and digest.

``finding(target_id, module, type, severity, location, evidence, n_counted)``; ``n_counted`` is 0 for
findings that are shown but do not count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls
from sitewarden.functions.frames import first_k, ordered_text
from sitewarden.functions.text import literals, lookup
from sitewarden.operators.javascript import CALL, first_of_target
from sitewarden.operators.secrets import CUT_END, CUT_START, HIDDEN
from sitewarden.rules import paths, remediation, report, secrets
from sitewarden.rules.headers import EXPECTED

#: Rules that do not apply to places.
PLACES = ("IP Address (Private)",)
FINDING = ["target_id", "module", "type", "severity", "location", "evidence", "n_counted"]


def hidden(text: Column, but: tuple[str, ...] = ()) -> Column:
    """A text without anything that a credential rule (except those of ``but``) matches."""
    return F.regexp_replace(text, "(?d)" + secrets.any_credential(but), HIDDEN)


def hidden_ends(text: Column, start: Column, end: Column) -> Column:
    """A text that was cut out of a longer one, without what its cut ends may leave of a credential."""
    shown = hidden(text)
    shown = F.when(start, F.regexp_replace(shown, CUT_START, HIDDEN)).otherwise(shown)
    return F.when(end, F.regexp_replace(shown, CUT_END, HIDDEN)).otherwise(shown)


def as_findings(rows: DataFrame, module: str, type_: Column, severity: Column, location: Column, evidence: Column,
                counted: int = 1) -> DataFrame:
    """Rows of a module under the common schema. ``evidence`` holds no credential; in places they are hidden here, but
    addresses of private networks stay."""
    return rows.select(
        "target_id",
        F.lit(module).alias("module"),
        type_.alias("type"),
        severity.alias("severity"),
        hidden(location.cast("string"), PLACES).alias("location"),
        evidence.cast("string").alias("evidence"),
        F.lit(counted).cast("bigint").alias("n_counted"),
    )


def _title_and_text() -> Column:
    return F.concat("name", F.lit(": "), "description")


def findings_union(modules: dict[str, DataFrame]) -> DataFrame:
    """Results of the modules under one schema. Keys: transport, headers, header_leaks, builders, secrets,
    paths, cookies, forms, leaks, js, api, wp, git; absent modules are left out."""
    c, lit, text = F.col, F.lit, lambda name: hidden(F.col(name))
    cut = (c("pattern") != CALL) if "js" in modules else None
    shape = {
        "transport": lambda: (c("status"), c("severity"), c("url"), lit(None)),
        "headers": lambda: (lit("Missing header"), c("severity"), c("header"), c("patch")),
        "header_leaks": lambda: (lit("Header disclosure"), lit("LOW"), c("header"), text("value")),
        "builders": lambda: (c("tool"), lit("INFO"), c("matched_pattern"), hidden_ends(c("evidence"), lit(True), lit(True))),
        "secrets": lambda: (c("type"), c("severity"), c("location"), c("value_masked")),
        "paths": lambda: (lit("Exposed path"), c("severity"), c("path"), hidden_ends(c("snippet"), lit(False), c("size") > paths.SNIPPET)),
        "cookies": lambda: (lit("Cookie issue"), lit("MEDIUM"), c("name"), c("issue")),
        "forms": lambda: (lit("Form issue"), lit("MEDIUM"), c("action"), c("issue")),
        "leaks": lambda: (c("type"), c("severity"), lit(None), text("content")),
        "js": lambda: (c("pattern"), c("severity"), c("source"), hidden_ends(c("context"), cut, cut)),
        "api": lambda: (c("type"), c("severity"), c("url"), text("description")),
        "wp": lambda: (c("type"), c("severity"), c("url"), hidden(_title_and_text())),
        "git": lambda: (c("type"), c("severity"), c("url"), hidden(_title_and_text())),
    }
    frames = [
        as_findings(rows, name, *shape[name](), counted=0 if name == "js" else 1) for name, rows in modules.items()
    ]
    return reduce(DataFrame.unionByName, frames)


def severity_counts(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Counted findings per severity for every target. One shuffle: targets come in as rows that count nothing."""
    rows = findings.select("target_id", "severity", "n_counted").unionByName(
        targets.select("target_id", F.lit("INFO").alias("severity"), F.lit(0).cast("bigint").alias("n_counted"))
    )
    per = [
        F.sum(F.when(F.col("severity") == s, F.col("n_counted")).otherwise(0)).alias(s.lower())
        for s in report.SEVERITIES
    ]
    counted = rows.groupBy("target_id").agg(*per)
    return counted.withColumn("total", reduce(Column.__add__, [F.col(s.lower()) for s in report.SEVERITIES]))


def severity_rollup(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Counted findings by host and severity, by host, and in all (`host`, `severity` null); `level` says which.

    The counts of a target become rows behind the join, and these are added up in the map tasks.
    """
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s.lower()).alias("n")) for s in report.SEVERITIES])
    hosts = targets.select("target_id", urls.hostname(urls.normalize(F.col("url"))).alias("host"))
    each = counts.join(hosts, "target_id").select("host", F.inline(rows))
    summed = each.rollup("host", "severity").agg(F.sum("n").alias("n"), F.grouping_id().cast("bigint").alias("level"))
    return summed.select("host", "severity", "level", "n")


def severity_bars(counts: DataFrame) -> DataFrame:
    """One row per target and severity with the length of its bar relative to the largest count."""
    names = [s.lower() for s in report.SEVERITIES]
    top = F.greatest(*names, F.lit(1))
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("severity"),
                F.col(n).alias("n"),
                F.floor(F.col(n) * report.BAR_WIDTH / top).alias("bar_len"),
            )
            for s, n in zip(report.SEVERITIES, names)
        ]
    )
    bars = counts.select("target_id", F.inline(rows))
    return bars.withColumn("bar", F.repeat(F.lit("█"), F.col("bar_len").cast("int")))


def grade(counts: DataFrame) -> DataFrame:
    letter = (
        F.when(F.col("total") == 0, "A+")
        .when(F.col("critical") > 0, "F")
        .when(F.col("high") > 2, "D")
        .when(F.col("high") > 0, "C")
        .when(F.col("medium") > 3, "B-")
        .otherwise("B+")
    )
    return counts.select("target_id", "total", letter.alias("grade"))


def remediation_join(secret_findings: DataFrame) -> DataFrame:
    """Advice per credential finding. The table has 21 fixed entries, so it is an expression, not a join."""
    return secret_findings.withColumn(
        "advice", lookup(F.col("type"), remediation.SECRET_ADVICE, remediation.SECRET_DEFAULT)
    )


def path_remediation(exposures: DataFrame) -> DataFrame:
    return exposures.withColumn("advice", lookup(F.col("path"), remediation.PATH_ADVICE, remediation.PATH_DEFAULT))


def js_remediation(counts: DataFrame) -> DataFrame:
    """Patterns with advice and how often they occur."""
    return counts.withColumn("advice", lookup(F.col("pattern"), remediation.SINK_ADVICE)).filter(
        F.col("advice").isNotNull()
    )


def target_digest(targets: DataFrame, technologies: DataFrame, secret_findings: DataFrame, js: DataFrame,
                  exposures: DataFrame, missing: DataFrame, cookie_counts: DataFrame) -> DataFrame:
    """Text summary of a target.

    Every section is a row (section, order, line); one aggregation joins the lines. The sections of scripts (5 lines)
    and credentials (2,000 lines) are cut, which is a feature of the digest; the others are bounded by fixed lists (29
    technologies, 70 paths with their statuses, 7 headers, 2 cookie lines), whatever the size of its input.
    """
    def lines(rows: DataFrame, section: int, order: Column, line: Column) -> DataFrame:
        return rows.select(
            "target_id", F.lit(section).alias("section"), order.cast("string").alias("o"), line.alias("line")
        )

    severity = F.concat(F.lit(" (Severity: "), "severity", F.lit(")"))
    tech = lines(technologies, 1, F.col("technology"), F.col("technology"))
    ranked = secret_findings.withColumn("ord", _rule_order(F.col("type")))
    secret = lines(
        first_k(ranked, ["target_id"], ["ord", "value_masked"], 2000), 2,
        F.concat(F.lpad(_rule_order(F.col("type")).cast("string"), 3, "0"), "value_masked"),
        F.concat(F.lit("  - "), "type", F.lit(": "), "value_masked", severity),
    )
    scripts = lines(
        first_of_target(js, report.DIGEST_JS_ROWS), 3, F.lpad(F.col("n").cast("string"), 3, "0"),
        F.concat(F.lit("  - "), "pattern", F.lit(": "), "description"),
    )
    files = lines(
        exposures.select("target_id", "path", "status").distinct(), 4, F.lpad(_path_order(F.col("path")).cast("string"), 3, "0"),
        F.concat(F.lit("  - "), "path", F.lit(" (Status: "), F.col("status").cast("string"), F.lit(")")),
    )
    headers = lines(
        missing, 5, F.lpad(_header_order(F.col("header")).cast("string"), 3, "0"),
        F.concat(F.lit("  - "), "header", F.lit(" ("), "severity", F.lit(")")),
    )
    n_insecure = F.col("n_insecure")
    cookie_line = F.concat(
        F.lit("\n" + report.DIGEST_COOKIES), F.col("n_cookies").cast("string"),
        F.when(n_insecure > 0, F.concat(F.lit("\n  - "), n_insecure.cast("string"), F.lit(report.DIGEST_INSECURE)))
        .otherwise(F.lit("")),
    )
    cookies = lines(cookie_counts, 6, F.lit(""), cookie_line)
    first = lines(targets, 0, F.lit(""), F.concat(F.lit(report.DIGEST_TARGET), "url", F.lit("\n")))
    rows = reduce(DataFrame.unionByName, [first, tech, secret, scripts, files, headers, cookies])

    def section(n: int, separator: str) -> Column:
        entry = F.when(F.col("section") == n, F.struct("o", F.col("line").alias("text")))
        return F.nullif(ordered_text(entry, separator), F.lit(""))

    labels = {2: report.DIGEST_SECRETS, 3: report.DIGEST_JS, 4: report.DIGEST_PATHS, 5: report.DIGEST_HEADERS}
    parts = [section(0, "")]
    parts.append(F.concat(F.lit("\n" + report.DIGEST_TECH), section(1, ", ")))
    parts += [F.concat(F.lit(f"\n{label}\n"), section(n, "\n")) for n, label in labels.items()]
    parts.append(section(6, ""))
    text = rows.groupBy("target_id").agg(F.concat_ws("\n", *parts).alias("digest"))
    short = F.length("digest") < report.DIGEST_SHORT
    return text.withColumn(
        "digest", F.when(short, F.concat("digest", F.lit("\n\n" + report.DIGEST_FILLER))).otherwise(F.col("digest"))
    )


def _position(value: Column, names: list[str]) -> Column:
    return F.array_position(literals(names), value)


def _rule_order(rule: Column) -> Column:
    return _position(rule, list(secrets.PATTERNS))


def _path_order(path: Column) -> Column:
    return _position(path, paths.SENSITIVE)


def _header_order(header: Column) -> Column:
    return _position(header, list(EXPECTED))


def module_error_rows(targets: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Inputs a module could not read; they do not stop the others."""
    bad_address = targets.filter(urls.netloc(urls.normalize(F.col("url"))) == "").select(
        "target_id", F.lit("target").alias("module"), F.col("url").alias("input")
    )
    return bad_address.unionByName(unreadable)
