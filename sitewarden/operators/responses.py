"""Classification of captured responses. The path list is a literal set, so it reaches the scan as a filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls
from sitewarden.functions.text import contains_any, left, one_line, strip
from sitewarden.rules import paths, report


def path_severity(path: Column) -> Column:
    first, *rest = [(severity, contains_any(path, words)) for severity, words in paths.SEVERITY_BY_SUBSTRING]
    return reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rest, F.when(first[1], F.lit(first[0]))).otherwise(
        F.lit("MEDIUM")
    )


def path_verified(path: Column, body: Column) -> Column:
    """Does the body look like the file the path names? True for paths without a check."""
    text = strip(body)
    return (
        F.when(
            F.contains(path, F.lit(".git/HEAD")),
            F.rlike(body, F.lit(r"ref:\s+refs/")) | F.rlike(text, F.lit("^[0-9a-f]{40}")),
        )
        .when(F.contains(path, F.lit(".ssh/id_")), text.startswith("-----BEGIN"))
        .otherwise(F.lit(True))
    )


def path_snippet(body: Column) -> Column:
    return one_line(left(body, paths.SNIPPET))


def is_html(body: Column, content_type: Column) -> Column:
    text = strip(body)
    return (
        text.startswith("<!DOCTYPE html>")
        | text.startswith("<html")
        | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
    )


def path_exposure(responses: DataFrame) -> DataFrame:
    """Known paths that answered with a real file."""
    path, body = F.col("path"), F.col("body")
    hits = (
        responses.filter(path.isin(paths.SENSITIVE) & (F.col("status") == 200))
        .filter(F.length(body) > paths.MIN_BODY)
        .filter(~is_html(body, F.col("content_type")))
        .filter(path_verified(path, body))
        .filter(~contains_any(F.lower(body), paths.ERROR_WORDS))
    )
    return hits.select(
        "target_id",
        "path",
        F.col("status").cast("bigint").alias("status"),
        F.length(body).cast("bigint").alias("size"),
        path_snippet(body).alias("snippet"),
        path_severity(path).alias("severity"),
    )


def api_documents(responses: DataFrame) -> DataFrame:
    """Bodies that the two interface modules read, ``(target_id, module, path, document)``, each parsed once.

    ``document`` is null where the body is not JSON (an empty one neither); rows without a body are left out.
    """
    path, body = F.col("path"), F.col("body")
    described = path.isin(paths.OPENAPI) & F.contains("content_type", F.lit("application/json"))
    module = F.when(described, F.lit("openapi")).when(path.isin(paths.GRAPHQL), F.lit("graphql"))
    read = responses.filter((F.col("status") == 200) & body.isNotNull()).withColumn("module", module)
    return read.filter(F.col("module").isNotNull()).select("target_id", "module", "path", F.try_parse_json(body).alias("document"))


def unreadable_bodies(documents: DataFrame) -> DataFrame:
    """Rows of :func:`api_documents` that are not JSON. They name the path; a body may hold anything and is not shown."""
    return documents.filter(F.col("document").isNull()).select("target_id", "module", F.col("path").alias("input"))


def _key(document: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(document), name), F.lit(False))


def openapi_audit(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """Exposed interface descriptions: title, version, number of paths, whether sign-in is defined."""
    body = F.col("body")
    documents = responses.filter(
        F.col("path").isin(paths.OPENAPI)
        & (F.col("status") == 200)
        & F.contains("content_type", F.lit("application/json"))
    ).filter(_key(body, "swagger") | _key(body, "openapi"))
    parsed = documents.select(
        "target_id",
        "path",
        F.coalesce(F.get_json_object(body, "$.info.title"), F.lit(report.OPENAPI_NO_TITLE)).alias("title"),
        F.coalesce(F.get_json_object(body, "$.info.version"), F.lit(report.OPENAPI_NO_VERSION)).alias("version"),
        F.coalesce(F.size(F.json_object_keys(F.get_json_object(body, "$.paths"))), F.lit(0))
        .cast("bigint")
        .alias("n_endpoints"),
        (
            _key(body, "securityDefinitions") | _key(F.get_json_object(body, "$.components"), "securitySchemes")
        ).alias("has_auth"),
    )
    sign_in = F.when(F.col("has_auth"), F.lit("Yes")).otherwise(F.lit("NO (Unauthenticated API)"))
    text = F.concat(
        F.lit("Swagger/OpenAPI schema exposed.\nAPI Title: "), "title", F.lit(" (v"), "version",
        F.lit(")\nEndpoints Exposed: "), F.col("n_endpoints").cast("string"),
        F.lit("\nAuthentication Defined: "), sign_in,
    )
    return _with_address(
        parsed.withColumn("severity", F.when(F.col("has_auth"), F.lit("MEDIUM")).otherwise(F.lit("HIGH")))
        .withColumn("type", F.lit("Swagger Schema"))
        .withColumn("description", text),
        targets,
    )


def graphql_audit(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """Endpoints that answer an introspection query."""
    open_schema = responses.filter(F.col("path").isin(paths.GRAPHQL) & (F.col("status") == 200)).filter(
        _key(F.get_json_object("body", "$.data"), "__schema")
    )
    return _with_address(
        open_schema.select(
            "target_id",
            "path",
            F.lit("GraphQL Introspection").alias("type"),
            F.lit(report.GRAPHQL_TEXT).alias("description"),
            F.lit("CRITICAL").alias("severity"),
        ),
        targets,
    )


def _with_address(hits: DataFrame, targets: DataFrame) -> DataFrame:
    base = targets.select("target_id", urls.base(F.col("url")).alias("base"))
    return hits.join(base, "target_id").withColumn("url", F.concat("base", "path")).drop("base", "path")
