"""Findings from the reports of other scanners: rows ``(target_id, tool, line)``, with ``url`` if ``at_sites`` gave one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.rules import report

VULNERABILITY = "STRUCT<title: STRING, description: STRING, references: STRUCT<url: ARRAY<STRING>>>"
WP_SCHEMA = (
    f"STRUCT<vulnerabilities: ARRAY<{VULNERABILITY}>, plugins: MAP<STRING, STRUCT<vulnerabilities: ARRAY<{VULNERABILITY}>>>>"
)
GIT_SCHEMA = "ARRAY<STRUCT<RuleID: STRING, File: STRING, StartLine: STRING>>"
COLUMNS = ["target_id", "name", "severity", "description", "type", "url"]


def at_sites(reports: DataFrame, sites: DataFrame) -> DataFrame:
    """Report lines of the given targets ``(target_id, url)``, with their address. Lines of other targets go before
    anything of them is parsed."""
    return reports.select("target_id", "tool", "line").join(sites.select("target_id", "url"), "target_id")


def _located(reports: DataFrame) -> DataFrame:
    return reports if "url" in reports.columns else reports.withColumn("url", F.lit(None).cast("string"))


def wp_lines(reports: DataFrame) -> DataFrame:
    return _located(reports).filter(F.col("tool") == "wp")


def git_lines(reports: DataFrame) -> DataFrame:
    return _located(reports).filter(F.col("tool") == "git")


def wp_report_findings(reports: DataFrame) -> DataFrame:
    """Core and plugin vulnerabilities; lines that are not JSON or name no target are passed over."""
    parsed = (
        wp_lines(reports)
        .filter(F.coalesce(F.array_contains(F.json_object_keys("line"), "target"), F.lit(False)))
        .select("target_id", "url", F.from_json("line", WP_SCHEMA).alias("r"))
    )
    reference = F.coalesce(F.try_element_at(F.col("v.references.url"), F.lit(1)), F.lit(report.WP_NO_REFERENCE))
    core = parsed.select("target_id", "url", F.explode("r.vulnerabilities").alias("v")).select(
        "target_id",
        F.coalesce("v.title", F.lit(report.WP_NO_TITLE)).alias("name"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.coalesce("v.description", F.lit("")), F.lit(" | Ref: "), reference).alias("description"),
        F.lit("wordpress_vuln").alias("type"),
        "url",
    )
    plugins = (
        parsed.select("target_id", "url", F.explode("r.plugins").alias("plugin", "p"))
        .select("target_id", "url", "plugin", F.explode("p.vulnerabilities").alias("v"))
        .select(
            "target_id",
            F.concat(
                F.lit("Plugin: "), "plugin", F.lit(" - "), F.coalesce("v.title", F.lit(report.WP_PLUGIN_NO_TITLE))
            ).alias("name"),
            F.lit("HIGH").alias("severity"),
            F.coalesce("v.description", F.lit("")).alias("description"),
            F.lit("plugin_vuln").alias("type"),
            "url",
        )
    )
    return core.unionByName(plugins)


def wp_report_clean(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Targets that were scanned without a finding."""
    scanned = wp_lines(reports).groupBy("target_id").agg(F.max("url").alias("url"))
    return scanned.join(findings.select("target_id").distinct(), "target_id", "left_anti").select(
        "target_id",
        F.lit(report.WP_CLEAN_NAME).alias("name"),
        F.lit("INFO").alias("severity"),
        F.lit(report.WP_CLEAN_TEXT).alias("description"),
        F.lit("wordpress_clean").alias("type"),
        "url",
    )


def git_report_findings(reports: DataFrame) -> DataFrame:
    lists = git_lines(reports).filter(F.json_array_length("line").isNotNull())
    leaks = lists.select("target_id", "url", F.explode(F.from_json("line", GIT_SCHEMA)).alias("l"))
    return leaks.select(
        "target_id",
        F.coalesce("l.RuleID", F.lit(report.GIT_NO_RULE)).alias("name"),
        F.lit("CRITICAL").alias("severity"),
        F.concat(
            F.lit("File: "), F.coalesce("l.File", F.lit(report.GIT_NO_FILE)),
            F.lit(", Line: "), F.coalesce("l.StartLine", F.lit(report.GIT_NO_LINE)),
        ).alias("description"),
        F.lit("exposed_secret").alias("type"),
        "url",
    )


def last_repository(repos: DataFrame) -> DataFrame:
    """``(target_id, repo, url)``: the last of the listed repositories of a target and its address."""
    last = repos.groupBy("target_id").agg(F.max("repo").alias("repo"))
    return last.withColumn("url", F.concat(F.lit("https://"), "repo"))


def git_report_fallback(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Targets that link a repository and have no leak: the last of their listed repositories.

    ``repos`` are rows of :func:`sitewarden.operators.fingerprint.repo_links`.
    """
    last = last_repository(repos)
    return last.join(findings.select("target_id").distinct(), "target_id", "left_anti").select(
        "target_id",
        F.lit(report.GIT_SEEN_NAME).alias("name"),
        F.lit("INFO").alias("severity"),
        F.concat(
            F.lit("GitHub repo detected: "), "repo", F.lit(". Provide GitHub token for full scan.")
        ).alias("description"),
        F.lit("github_detected").alias("type"),
        "url",
    )


def unreadable_lines(reports: DataFrame) -> DataFrame:
    """Report lines that are not JSON of the expected kind."""
    bad = F.when(F.col("tool") == "wp", F.json_object_keys("line").isNull()).otherwise(
        F.json_array_length("line").isNull()
    )
    return reports.filter(bad).select("target_id", F.concat(F.lit("tool_report:"), "tool").alias("module"), F.col("line").alias("input"))
