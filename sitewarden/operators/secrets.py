"""Credential scan over resource rows ``(target_id, seq, kind, url, content)``.

One pass over the text yields narrow match rows; the text itself stays in the scan stage. Context rules,
places and de-duplication run on the match rows, as partial aggregates. All matches count; ``cap`` drops a rule
from a target where it matches more often, and is off unless it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import matching
from sitewarden.functions.frames import drop_large_groups, first_k
from sitewarden.functions.text import contains_any, found, literals, mask
from sitewarden.rules import false_positives as fp
from sitewarden.rules import secrets

SCAN_ORDER = ["kind_ord", "seq", "url", "pos"]
HIDDEN = "****"
# What may be the rest of a credential that the edge of a context cuts.
CUT_START, CUT_END = r"^[A-Za-z0-9+/_=.-]{8,}", r"[A-Za-z0-9+/_=.-]{8,}$"
KIND_ORDER = {"html": 0, "js": 1, "css": 2}


def kind_order() -> Column:
    order = F.lit(len(KIND_ORDER))
    for kind, n in KIND_ORDER.items():
        order = F.when(F.col("kind") == kind, F.lit(n)).otherwise(order)
    return order


def rule_name(order: Column) -> Column:
    return F.element_at(literals(matching.RULES), order.cast("int"))


def rule_severity(rule: Column) -> Column:
    return (
        F.when(rule.isin(secrets.CRITICAL), F.lit("CRITICAL"))
        .when(rule.isin(secrets.HIGH), F.lit("HIGH"))
        .otherwise(F.lit("MEDIUM"))
    )


def secret_matches(resources: DataFrame, gated: bool = True, keep: int | None = None) -> DataFrame:
    """Every match of every rule with its surroundings, one row per match.

    With ``keep`` only that many matches of a rule are kept per resource.
    """
    keys = [c for c in resources.columns if c != "content"]  # the text stays behind
    marked = matching.WORDS.mark(resources, "content") if gated else resources
    matched = marked.select(*keys, "content", matching.credential_matches("content", gated).alias("_matches"))
    hits = matched.select(
        *keys, F.explode(matching.credential_hits(F.col("content"), F.col("_matches"), keep)).alias("_hit")
    )
    return hits.select(*keys, "_hit.*").withColumn("rule", rule_name(F.col("ord")))


def match_rows_of(parsed: DataFrame) -> DataFrame:
    """Match rows of ``(target_id, seq, kind, url, secrets)``."""
    return parsed.select("target_id", "seq", "kind", "url", F.inline("secrets")).withColumn(
        "rule", rule_name(F.col("ord"))
    )


def apply_cap(matches: DataFrame, cap: int = secrets.MATCH_CAP) -> DataFrame:
    """Drop a rule in a target where it has more than ``cap`` matches."""
    return drop_large_groups(
        matches.withColumn("kind_ord", kind_order()), ["target_id", "ord"], SCAN_ORDER, cap
    ).drop("kind_ord")


def global_suppressor() -> Column:
    return found(F.col("context"), "(?i)" + "|".join(fp.GLOBAL_CONTEXT))


def rule_suppressor() -> Column:
    """Number of the first rule (F1..F14) that suppresses the match, else null."""
    rule, value, context = F.col("rule"), F.col("value"), F.col("context")
    inner = F.lower(F.regexp_extract(value, secrets.PATTERNS["Generic Secret"], 1))
    generic = F.when(contains_any(inner, fp.LABEL_WORDS), F.lit("F4"))
    for number, pattern, fold in fp.GENERIC_CONTEXT:
        generic = generic.when(found(context, ("(?i)" if fold else "") + pattern), F.lit(number))
    return (
        F.when((rule == "IP Address (Private)") & found(context, "(?i)" + fp.VERSION_CONTEXT), F.lit("F1"))
        .when(rule.isin("JWT Token", "Supabase Key") & contains_any(F.lower(context), fp.STYLE_WORDS), F.lit("F2"))
        .when((rule == "Google API Key") & contains_any(value, fp.PLACEHOLDERS), F.lit("F3"))
        .when(rule == "Generic Secret", generic)
    )


def suppression() -> Column:
    return F.when(global_suppressor(), F.lit("global")).otherwise(rule_suppressor())


def masked_value(value: Column) -> Column:
    return mask(value, secrets.MASK_LONGER_THAN, secrets.MASK_HEAD, secrets.MASK_TAIL, secrets.MASK_SHORT_HEAD)


def masked() -> Column:
    return masked_value(F.col("value"))


def judge(matches: DataFrame, strict: bool = False) -> DataFrame:
    """Drop suppressed matches; ``strict`` keeps them with the reason in ``suppressed_by``."""
    judged = matches.withColumn("suppressed_by", suppression())
    return judged if strict else judged.filter(F.col("suppressed_by").isNull()).drop("suppressed_by")


def shown_context(context: Column, value: Column) -> Column:
    """A context without credentials: the value as its mask, other matches and cut ends hidden."""
    shown = F.replace(context, F.translate(value, "\n", " "), masked_value(value))
    for pattern in ("(?d)" + secrets.any_credential(), CUT_START, CUT_END):
        shown = F.regexp_replace(shown, pattern, HIDDEN)
    return shown


def to_findings(matches: DataFrame) -> DataFrame:
    """Replace values by their mask; no raw credential leaves this step, in the context neither."""
    kept = matches.withColumn("value_masked", masked()).withColumn("value_hash", F.sha2("value", 256))
    return kept.withColumn("context", shown_context(F.col("context"), F.col("value"))).withColumn(
        "severity", rule_severity(F.col("rule"))
    ).drop("value").withColumnRenamed("rule", "type")


def secret_values(matches: DataFrame, strict: bool = False) -> DataFrame:
    """One row per (target, rule, value) that is not suppressed everywhere (``strict``: with the suppressed ones).

    The location is the first style sheet that holds the value, else the first script, else the page, wherever a
    context rule looked away as well. One partial aggregate; a group of any size is reduced before the shuffle.
    """
    place = F.when(F.col("kind") == "css", F.lit(0)).when(F.col("kind") == "js", F.lit(1)).otherwise(F.lit(2))
    rows = judge(matches, strict=True).withColumn("kind_ord", kind_order())
    free = F.lit(True) if strict else F.col("suppressed_by").isNull()
    row = F.struct(*SCAN_ORDER, "context", "value", "suppressed_by")
    values = rows.groupBy("target_id", "ord", "rule", F.sha2("value", 256).alias("value_hash")).agg(
        F.min_by("url", F.struct(place, "seq", "url")).alias("location"), F.min(F.when(free, row)).alias("first")
    )
    return values.filter(F.col("first").isNotNull()).withColumn("value_masked", masked_value(F.col("first.value")))


def secret_locations(matches: DataFrame) -> DataFrame:
    return secret_values(matches).select("target_id", F.col("rule").alias("type"), "value_masked", "value_hash", "location")


def dedup(findings: DataFrame) -> DataFrame:
    """First finding per (target, type, masked value) in scan order."""
    ordered = findings.withColumn("kind_ord", kind_order())
    return first_k(ordered, ["target_id", "ord", "type", "value_masked"], SCAN_ORDER, 1).drop("kind_ord")


def secret_findings(resources: DataFrame, strict: bool = False, gated: bool = True, cap: int | None = None) -> DataFrame:
    """The whole scan: matches, context rules, mask, place, de-duplication; ``cap`` as in :func:`findings_of`."""
    return findings_of(secret_matches(resources, gated, keep=None if cap is None else cap + 1), strict, cap)


def findings_of(matches: DataFrame, strict: bool = False, cap: int | None = None) -> DataFrame:
    """The part of the scan behind the text pass; takes rows of :func:`secret_matches`.

    Values of one target that share a mask are one finding; ``n_values`` says how many they are.
    """
    values = secret_values(matches if cap is None else apply_cap(matches, cap), strict)
    keys = ["target_id", "ord", "rule", "value_masked"]
    found_rows = values.groupBy(*keys).agg(F.min(F.struct("first", "location")).alias("f"), F.count(F.lit(1)).alias("n_values"))
    extra = [F.col("f.first.suppressed_by").alias("suppressed_by")] if strict else []
    return found_rows.select(
        "target_id", F.col("rule").alias("type"), "value_masked", F.col("f.location").alias("location"),
        shown_context(F.col("f.first.context"), F.col("f.first.value")).alias("context"),
        rule_severity(F.col("rule")).alias("severity"), "n_values", *extra,
    )


def secret_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


def historical_only(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Values of archived match rows that are not live any more, by the value, not by its mask."""
    gone = secret_values(archived).join(secret_values(live), ["target_id", "rule", "value_hash"], "left_anti")
    return gone.select(
        "target_id", F.col("rule").alias("type"), "value_masked", "value_hash", "location", rule_severity(F.col("rule")).alias("severity")
    )
