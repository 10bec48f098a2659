"""Sinks and external calls in script resources ``(target_id, seq, url, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions.frames import first_k
from sitewarden.functions.text import around, extract_all, left, one_line, quoted, right
from sitewarden.rules import javascript as rules
from sitewarden.rules import report

CALL = "API Endpoint"
COLUMNS = ["target_id", "seq", "ord", "pattern", "description", "source", "context", "severity"]


def sinks(content: Column) -> Column:
    """``array<struct>``: first place of each sink in a script."""
    table = ", ".join(
        f"named_struct('ord', {n}L, 'pattern', {quoted(literal)}, 'description', {quoted(description)})"
        for n, (literal, description) in enumerate(rules.SINKS.items(), 1)
    )
    places = F.transform(
        F.filter(F.expr(f"array({table})"), lambda s: F.contains(content, s["pattern"])),
        lambda s: F.struct(
            s["ord"].alias("ord"), s["pattern"].alias("pattern"), s["description"].alias("description"),
            F.position(s["pattern"], content).alias("at"),
        ),
    )
    return F.transform(
        places,
        lambda p: F.struct(
            p["ord"].alias("ord"),
            p["pattern"].alias("pattern"),
            p["description"].alias("description"),
            one_line(around(content, p["at"] - 1, F.length(p["pattern"]), rules.CONTEXT_RADIUS)).alias("context"),
            F.lit("MEDIUM").alias("severity"),
        ),
    )


def calls(content: Column) -> Column:
    """``array<struct>``: addresses of fetch calls, then of request objects."""
    addresses = F.concat(extract_all(content, rules.FETCH_CALL, 1), extract_all(content, rules.XHR_CALL, 1))
    return F.transform(
        F.filter(addresses, lambda u: u.startswith("http")),
        lambda u, i: F.struct(
            (i + len(rules.SINKS) + 1).cast("bigint").alias("ord"),
            F.lit(CALL).alias("pattern"),
            F.concat(F.lit("External API call: "), u).alias("description"),
            u.alias("context"),
            F.lit("INFO").alias("severity"),
        ),
    )


def _rows(scripts: DataFrame, found: Column) -> DataFrame:
    return scripts.select("target_id", "seq", F.col("url").alias("source"), F.inline(found)).select(*COLUMNS)


def js_sinks(scripts: DataFrame) -> DataFrame:
    """First place of each sink in each script."""
    return _rows(scripts, sinks(F.col("content")))


def js_api_calls(scripts: DataFrame) -> DataFrame:
    """Calls to absolute addresses: fetch first, then request objects."""
    return _rows(scripts, calls(F.col("content")))


def script_findings(content: Column) -> Column:
    """Sinks, then calls, of one script."""
    return F.concat(sinks(content), calls(content))


def js_findings(scripts: DataFrame) -> DataFrame:
    return _rows(scripts, script_findings(F.col("content")))


def js_findings_of(parsed: DataFrame) -> DataFrame:
    """Rows of ``(target_id, seq, url, script_findings)``."""
    return _rows(parsed, F.col("script_findings"))


def js_dedup(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """First finding per (target, pattern, source); ``limit`` keeps the first ones of a target."""
    first = first_k(findings, ["target_id", "pattern", "source"], ["seq", "ord", "context"], 1)
    kept = first if limit is None else first_k(first, ["target_id"], ["seq", "source", "ord"], limit)
    return kept.select(*COLUMNS)


def first_of_target(deduped: DataFrame, k: int) -> DataFrame:
    """The first k findings of a target with their number ``n``."""
    return first_k(deduped, ["target_id"], ["seq", "source", "ord"], k, rank="n")


def js_pattern_counts(deduped: DataFrame) -> DataFrame:
    return deduped.groupBy("target_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


def js_report_rows(deduped: DataFrame) -> DataFrame:
    """The first twenty rows of a target with cut texts (the last characters of the source)."""
    return first_of_target(deduped, report.JS_ROWS).select(
        "target_id",
        "n",
        "pattern",
        left(F.col("description"), report.JS_TEXT_WIDTH).alias("risk"),
        right(F.col("source"), report.JS_TEXT_WIDTH).alias("source"),
    )
