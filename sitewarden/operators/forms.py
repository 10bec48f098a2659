"""Forms of captured pages. The checks take form rows of :func:`page_forms` or :func:`form_rows_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import html
from sitewarden.functions.text import contains_any, found
from sitewarden.rules import report


def parse(page: Column) -> Column:
    """``array<struct<a, inputs>>``: the forms of a page, null at once when there is none."""
    return F.when(
        found(page, "(?i)<form"),
        F.transform(
            html.blocks(html.without_code(page), "form"),
            lambda f: F.struct(
                html.attributes(f, "action", "method").alias("a"),
                F.transform(html.tags(f, "input"), lambda i: html.attributes(i, "name", "type", "id")).alias("inputs"),
            ),
        ),
    )


def page_forms(pages: DataFrame) -> DataFrame:
    return form_rows_of(pages.select(F.col("page_id").alias("target_id"), parse(F.col("html")).alias("forms")))


def form_rows_of(parsed: DataFrame) -> DataFrame:
    """One row per form of ``(target_id, forms)``, numbered in document order."""
    rows = parsed.select("target_id", F.posexplode("forms").alias("pos", "f"))
    return rows.select(
        "target_id",
        (F.col("pos") + 1).cast("bigint").alias("form_no"),
        F.coalesce("f.a.action", F.lit("")).alias("action"),
        F.upper(F.coalesce("f.a.method", F.lit("GET"))).alias("method"),
        F.col("f.inputs").alias("inputs"),
    )


def form_extract(forms: DataFrame) -> DataFrame:
    """One row per input; a form without inputs keeps one row."""
    rows = forms.select(
        "target_id", "form_no", "action", "method", F.posexplode_outer("inputs").alias("pos", "i")
    )
    given = F.col("pos").isNotNull()
    return rows.select(
        "target_id",
        "form_no",
        "action",
        "method",
        (F.col("pos") + 1).cast("bigint").alias("input_no"),
        F.when(given, F.coalesce("i.name", F.lit(""))).alias("input_name"),
        F.when(given, F.coalesce("i.type", F.lit("text"))).alias("input_type"),
        F.when(given, F.coalesce("i.id", F.lit(""))).alias("input_id"),
    )


def _has_csrf(field: Column) -> Column:
    name = F.lower(F.coalesce(field["name"], F.lit("")))
    return F.coalesce(field["type"] == "hidden", F.lit(False)) & contains_any(name, report.CSRF_WORDS)


def with_issues(forms: DataFrame) -> DataFrame:
    action, method = F.col("action"), F.col("method")
    aimless = (action == "") | (action == "#")
    checked = forms.select(
        "*",
        F.exists("inputs", _has_csrf).alias("has_csrf"),
        F.exists("inputs", lambda i: F.coalesce(i["type"] == "password", F.lit(False))).alias("has_password"),
    )
    issues = F.array_compact(
        F.array(
            F.when(
                ~F.col("has_csrf"),
                F.when(method != "GET", F.lit(report.FORM_NO_CSRF)).when(~aimless, F.lit(report.FORM_NO_CSRF_GET)),
            ),
            F.when((method == "GET") & F.col("has_password"), F.lit(report.FORM_PASSWORD_GET)),
            F.when(action.startswith("http://"), F.lit(report.FORM_OVER_HTTP)),
            F.when(aimless, F.lit(report.FORM_EMPTY_ACTION)),
        )
    )
    return checked.withColumn("issues", issues).filter(F.size("issues") > 0)


def _shown_action() -> Column:
    return F.when(F.col("action") == "", F.lit(report.FORM_NO_ACTION)).otherwise(F.col("action"))


def form_audit(forms: DataFrame) -> DataFrame:
    """One row per issue; forms without an issue are left out."""
    return with_issues(forms).select(
        "target_id", "form_no", _shown_action().alias("action"), "method", "has_csrf",
        F.posexplode("issues").alias("pos", "issue"),
    ).withColumn("n", (F.col("pos") + 1).cast("bigint")).drop("pos")


def form_rows(forms: DataFrame) -> DataFrame:
    """Report rows: the first eight inputs in one text."""
    shown = F.transform(
        F.slice("inputs", 1, report.FORM_INPUTS),
        lambda i: F.concat(
            F.coalesce(i["type"], F.lit("text")), F.lit("("), F.coalesce(i["name"], F.lit("")), F.lit(")")
        ),
    )
    return with_issues(forms).select(
        "target_id", "form_no", _shown_action().alias("action"), "method", "has_csrf",
        F.array_join(shown, ", ").alias("inputs"),
    )
