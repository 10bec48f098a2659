"""Headers, transport, certificate, DNS and WHOIS rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls
from sitewarden.functions.frames import first_k, ordered_text
from sitewarden.functions.text import left
from sitewarden.rules import headers as rules
from sitewarden.rules import report


#: What makes two rows the same certificate.
CERTIFICATE = ["target_id", "status", "subject", "issuer", "not_before", "not_after", "version", "serial", "error"]


def _value_of(header: str, order: list[str]) -> Column:
    """Values under the usual spelling, else under the lower-case spelling; repeated headers are joined in order."""

    def joined(spelling: str) -> Column:
        entry = F.struct(*order, F.col("value").alias("text"))
        return F.nullif(ordered_text(F.when((F.col("name") == spelling) & (F.col("value") != ""), entry), ", "), F.lit(""))

    return F.coalesce(joined(header), joined(header.lower()))


def _order_of(headers: DataFrame) -> list[str]:
    """Rows of one answer are in the order of `seq`; without that column, in the order of their values."""
    return ["seq"] if "seq" in headers.columns else []


def header_audit(targets: DataFrame, headers: DataFrame) -> DataFrame:
    """Seven expected headers per target. Header rows are reduced to one row per target before the join."""
    names, order = list(rules.EXPECTED), _order_of(headers)
    relevant = headers.filter(F.lower("name").isin([n.lower() for n in names]))
    present = relevant.groupBy("target_id").agg(
        *[F.max(F.lower("name") == n.lower()).alias(f"has_{i}") for i, n in enumerate(names)],
        *[F.coalesce(_value_of(n, order), F.lit("")).alias(f"value_{i}") for i, n in enumerate(names)],
    )
    checks = []
    for i, (name, (severity, description, patch)) in enumerate(rules.EXPECTED.items()):
        here = F.coalesce(F.col(f"has_{i}"), F.lit(False))
        checks.append(
            F.struct(
                F.lit(name).alias("header"),
                F.when(here, F.lit("PRESENT")).otherwise(F.lit("MISSING")).alias("status"),
                F.when(here, F.lit("OK")).otherwise(F.lit(severity)).alias("severity"),
                F.when(here, F.col(f"value_{i}")).alias("value"),
                F.when(~here, F.lit(description)).alias("description"),
                F.when(~here, F.lit(patch)).alias("patch"),
            )
        )
    return targets.select("target_id").join(present, "target_id", "left").select(
        "target_id", F.inline(F.array(*checks))
    )


def header_missing(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("status") == "MISSING").select(
        "target_id", "header", "severity", "description", "patch"
    )


def header_info_leak(headers: DataFrame) -> DataFrame:
    spellings = [s for h in rules.TELLING for s in (h, h.lower())]
    values = headers.filter(F.col("name").isin(spellings)).groupBy("target_id").agg(
        *[_value_of(h, _order_of(headers)).alias(h) for h in rules.TELLING]
    )
    rows = F.array(
        *[
            F.struct(F.lit(h).alias("header"), F.col(f"`{h}`").alias("value"), F.lit(risk).alias("risk"))
            for h, risk in rules.TELLING.items()
        ]
    )
    return values.select("target_id", F.inline(rows)).filter(F.col("value") != "")


def transport_audit(targets: DataFrame) -> DataFrame:
    return targets.filter(urls.scheme(F.col("url")) != "https").select(
        "target_id", "url", F.lit("NOT_HTTPS").alias("status"), F.lit("CRITICAL").alias("severity")
    )


def cert_inventory(certs: DataFrame) -> DataFrame:
    """One row per certificate of a target with its alternative names; fields only of valid certificates.

    Two certificates of one target stay apart, repeated captures of one are one row.
    """
    return _named(_cert_names(certs))


def cert_report_rows(certs: DataFrame) -> DataFrame:
    """Report rows: the first ten alternative names of each certificate."""
    names = first_k(_cert_names(certs).filter("alt_name IS NOT NULL"), CERTIFICATE, ["pos", "alt_name"], report.CERT_NAMES)
    return _named(names).select("target_id", "subject", "serial", "alt_names")


def _cert_names(certs: DataFrame) -> DataFrame:
    """One row per certificate and name; a name that is captured again counts once, at its first place."""
    valid = F.col("status") == "VALID"
    fields = [F.when(~valid if c == "error" else valid, F.col(c)).alias(c) for c in CERTIFICATE[2:]]
    rows = certs.select(*CERTIFICATE[:2], *fields, F.when(valid, F.col("alt_name")).alias("alt_name"), "pos")
    return rows.groupBy(*CERTIFICATE, "alt_name").agg(F.min("pos").alias("pos"))


def _named(names: DataFrame) -> DataFrame:
    text = ordered_text(F.struct("pos", F.col("alt_name").alias("text")), ", ")
    return names.groupBy(*CERTIFICATE).agg(F.when(F.col("status") == "VALID", text).alias("alt_names"))


def dns_rollup(records: DataFrame) -> DataFrame:
    """Number of different values per record type and the values in order; captures of the same values do not pile up."""
    return _shown(_dns_values(records))


def dns_report_rows(records: DataFrame) -> DataFrame:
    """Report rows: the first five values of each record type."""
    return _shown(first_k(_dns_values(records), ["target_id", "rtype"], ["pos", "value"], report.DNS_VALUES)).drop("n_values")


def _dns_values(records: DataFrame) -> DataFrame:
    """Values are reduced by a partial aggregate before any of them is listed."""
    return records.groupBy("target_id", "rtype", "value").agg(F.min("pos").alias("pos"))


def _shown(values: DataFrame) -> DataFrame:
    text = ordered_text(F.struct("pos", F.col("value").alias("text")), ", ")
    return values.groupBy("target_id", "rtype").agg(F.count(F.lit(1)).alias("n_values"), text.alias("shown"))


def whois_rows(whois: DataFrame) -> DataFrame:
    """The six registration fields as rows, without empty ones."""
    labels = {
        "registrar": "Registrar", "creation": "Creation", "expiration": "Expiration",
        "name_servers": "Name_Servers", "org": "Org", "country": "Country",
    }
    rows = F.array(*[F.struct(F.lit(label).alias("field"), F.col(c).alias("value")) for c, label in labels.items()])
    return (
        whois.select("target_id", F.inline(rows))
        .filter((F.col("value") != "") & (F.col("value") != "None"))
        .select("target_id", "field", "value")
    )
