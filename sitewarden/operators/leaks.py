"""Comments, source maps, error texts and framework configuration in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions.text import bind, contains_any, extract, extract_all, quoted, strip
from sitewarden.rules import leaks as rules

COMMENT = "Suspicious HTML Comment"
SOURCE_MAP = "Source Map Exposed"
DEBUG = "Error/Debug Info Exposed"


def comments(page: Column) -> Column:
    """``array<string>``: comments with a suspicious word; conditional comments do not count."""
    texts = F.transform(extract_all(page, r"(?s)<!--(.*?)-->", 1), strip)
    bad = F.filter(
        texts,
        lambda t: (F.length(t) > 5) & ~t.startswith("[if") & contains_any(F.lower(t), rules.COMMENT_WORDS),
    )
    return bad


def source_maps(content: Column) -> Column:
    """``array<string>``: every source map reference of a resource."""
    return F.when(F.contains(content, F.lit("sourceMappingURL=")), extract_all(content, rules.SOURCE_MAP, 1))


def debug_texts(page: Column) -> Column:
    """``array<string>``: first hit of each error text."""
    return F.array_compact(F.array(*[F.regexp_substr(page, F.lit("(?d)" + p)) for p in rules.ERRORS]))


def config_blobs(page: Column, lower: Column) -> Column:
    """``array<struct<label, blob>>``: first configuration object of each framework kind."""
    blobs = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.when(
                    F.contains(lower, F.lit(literal)), extract(page, pattern, 1)
                ).alias("blob"),
            )
            for label, pattern, literal in rules.CONFIG_BLOBS
        ]
    )
    return F.filter(blobs, lambda b: b["blob"].isNotNull())


def _found_keys(blob: Column) -> Column:
    """``array<struct<key, severity, value>>`` of the known keys, in report order."""
    table = ", ".join(
        f"named_struct('key', {quoted(key)}, 'severity', {quoted(severity)}, 'pattern', {quoted(rules.key_pattern(key))})"
        for key, severity in rules.CONFIG_KEYS
    )
    present = F.filter(F.expr(f"array({table})"), lambda k: F.rlike(blob, k["pattern"]))
    return F.transform(
        present,
        lambda k: F.struct(
            k["key"].alias("key"),
            k["severity"].alias("severity"),
            strip(F.regexp_extract_all(blob, k["pattern"], F.lit(1))[0]).alias("value"),
        ),
    )


def _config_findings(label: Column, keys: Column) -> Column:
    """``array<struct<type, content, severity>>``: each HIGH key, then a summary of all keys."""
    single = F.transform(
        F.filter(keys, lambda k: k["severity"].isin("HIGH", "CRITICAL")),
        lambda k: F.struct(
            F.concat(F.lit("Framework Config Leak — "), label).alias("type"),
            F.concat(k["key"], F.lit(": "), k["value"]).alias("content"),
            k["severity"].alias("severity"),
        ),
    )
    listed = F.transform(keys, lambda k: F.concat(k["key"], F.lit("="), k["value"]))
    summary = F.struct(
        F.concat(F.lit("Framework Config Exposed — "), label).alias("type"),
        F.concat(F.lit("Runtime config object injected in HTML exposes: "), F.array_join(listed, " | ")).alias("content"),
        F.lit("MEDIUM").alias("severity"),
    )
    return F.when(F.size(keys) > 0, F.concat(single, F.array(summary)))


def config_findings(blobs: Column) -> Column:
    """Findings of all configuration objects of a page."""
    each = F.transform(blobs, lambda b: bind(_found_keys(b["blob"]), lambda k: _config_findings(b["label"], k)))
    return F.flatten(F.filter(each, lambda f: f.isNotNull()))


def _rows(rows: DataFrame, kind: str, texts: Column, severity: str) -> DataFrame:
    return rows.select(
        "target_id", F.lit(kind).alias("type"), F.explode(texts).alias("content"), F.lit(severity).alias("severity")
    )


def _keyed(pages: DataFrame, *columns) -> DataFrame:
    return pages.select(F.col("page_id").alias("target_id"), *columns)


def comment_leak(pages: DataFrame) -> DataFrame:
    return _rows(_keyed(pages, "html"), COMMENT, comments(F.col("html")), "MEDIUM")


def sourcemap_leak(resources: DataFrame) -> DataFrame:
    return _rows(resources, SOURCE_MAP, source_maps(F.col("content")), "HIGH")


def debug_leak(pages: DataFrame) -> DataFrame:
    return _rows(_keyed(pages, "html"), DEBUG, debug_texts(F.col("html")), "HIGH")


def framework_config_blob(pages: DataFrame) -> DataFrame:
    lower = _keyed(pages, "html", F.lower("html").alias("_lower"))
    return lower.select("target_id", F.inline(config_blobs(F.col("html"), F.col("_lower"))))


def framework_config_keys(pages: DataFrame) -> DataFrame:
    lower = _keyed(pages, "html", F.lower("html").alias("_lower"))
    blobs = lower.select("target_id", config_blobs(F.col("html"), F.col("_lower")).alias("_blobs"))
    return blobs.select("target_id", F.inline(config_findings(F.col("_blobs"))))


def leaks_of(facts: DataFrame) -> DataFrame:
    """Leak findings from the arrays of one pass over the resources."""
    return (
        _rows(facts, COMMENT, F.col("comments"), "MEDIUM")
        .unionByName(_rows(facts, SOURCE_MAP, F.col("source_maps"), "HIGH"))
        .unionByName(_rows(facts, DEBUG, F.col("debug_texts"), "HIGH"))
        .unionByName(facts.select("target_id", F.inline("config_findings")))
    )
