"""Cookies from captured ``Set-Cookie`` rows ``(target_id, seq, url, set_cookie)``; ``seq`` is the order of arrival.

With a timestamp column ``captured_at`` dates of expiry are compared with it; without one, only with the epoch, at which
servers date the cookies that they delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls
from sitewarden.functions.text import strip
from sitewarden.rules import report


def _attribute(name: str) -> Column:
    """Value of an attribute, null when it is absent or empty."""
    value = strip(F.regexp_extract("set_cookie", rf"(?i);\s*{name}\s*=\s*([^;]*)", 1))
    return F.when(value != "", value)


def _flag(name: str) -> Column:
    return F.rlike("set_cookie", F.lit(rf"(?i);\s*{name}\s*(?:;|=|$)"))


def _expiry() -> Column:
    """The date of expiry, null when it cannot be read."""
    part = lambda n: F.regexp_extract("set_cookie", r"(?i);\s*expires\s*=[^;]*?(\d{1,2})[ -]([a-z]{3})[ -](\d{4}) +(\d\d:\d\d:\d\d)", n)
    return F.try_to_timestamp(F.concat_ws(" ", part(1), F.initcap(part(2)), part(3), part(4), F.lit("+0000")), F.lit("d MMM yyyy HH:mm:ss Z"))


def _removes(rows: DataFrame) -> Column:
    """Whether a row deletes its cookie: an age of zero or less, else a date of expiry that has passed."""
    age = F.regexp_extract("set_cookie", r"(?i);\s*max-age\s*=\s*(-?\d+)\s*(?:;|$)", 1)
    now = F.col("captured_at") if "captured_at" in rows.columns else F.timestamp_seconds(F.lit(0))
    return F.when(age != "", F.rlike(age, F.lit("^(-|0+$)"))).otherwise(F.coalesce(_expiry() <= now, F.lit(False)))


def _foreign(url: Column, domain: Column) -> Column:
    """Whether a cookie names a domain that its host does not belong to."""
    named, host = F.lower(F.regexp_replace(domain, r"^\.", "")), urls.hostname(url)
    return F.coalesce((host != named) & ~F.endswith(host, F.concat(F.lit("."), named)), F.lit(False))


def cookie_parse(rows: DataFrame) -> DataFrame:
    """The jar of each target: of cookies with one name, domain and path the last one counts.

    A last one that has expired leaves no cookie; a cookie for a foreign domain is refused.
    """
    url = F.col("url")
    domain = _attribute("domain")
    folder = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)/", 1)
    parsed = rows.filter(~_foreign(url, domain)).select(
        "target_id",
        "seq",
        "url",
        strip(F.regexp_extract("set_cookie", r"^([^=;]*)", 1)).alias("name"),
        F.when(domain.isNull(), urls.hostname(url))
        .when(domain.startswith("."), F.lower(domain))
        .otherwise(F.concat(F.lit("."), F.lower(domain)))
        .alias("domain"),
        F.coalesce(_attribute("path"), F.when(folder != "", folder), F.lit("/")).alias("path"),
        _flag("secure").alias("secure"),
        _flag("httponly").alias("httponly"),
        F.coalesce(_attribute("samesite"), F.lit(report.SAMESITE_DEFAULT)).alias("samesite"),
        _removes(rows).alias("removed"),
    )
    flags = ["url", "secure", "httponly", "samesite", "removed"]
    jar = parsed.groupBy("target_id", "name", "domain", "path").agg(F.max_by(F.struct(*flags), F.struct("seq", *flags)).alias("last"))
    return jar.filter(~F.col("last.removed")).select("target_id", "last.url", "name", "domain", "path", "last.secure", "last.httponly", "last.samesite")


def _issues() -> Column:
    insecure = F.when(urls.scheme(F.col("url")) == "https", F.lit(report.COOKIE_INSECURE_HTTPS)).otherwise(
        F.lit(report.COOKIE_INSECURE_HTTP)
    )
    return F.array_compact(
        F.array(
            F.when(~F.col("secure"), insecure),
            F.when(~F.col("httponly"), F.lit(report.COOKIE_NO_HTTPONLY)),
            F.when(F.col("samesite") == report.SAMESITE_DEFAULT, F.lit(report.COOKIE_NO_SAMESITE)),
        )
    )


def with_issues(cookies: DataFrame) -> DataFrame:
    return cookies.withColumn("issues", _issues())


def cookie_audit(cookies: DataFrame) -> DataFrame:
    """One row per issue."""
    return with_issues(cookies).select(
        "target_id", "name", F.posexplode("issues").alias("pos", "issue")
    ).select("target_id", "name", (F.col("pos") + 1).cast("bigint").alias("n"), "issue")


def insecure_cookie_count(cookies: DataFrame) -> DataFrame:
    return with_issues(cookies).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_cookies"), F.count_if(F.size("issues") > 0).alias("n_insecure")
    )


def cookie_rows(cookies: DataFrame) -> DataFrame:
    """Report rows: issues in one cut text."""
    shown = F.substring(F.array_join("issues", "; "), 1, report.COOKIE_ISSUE_WIDTH)
    return with_issues(cookies).select("target_id", "name", "secure", "httponly", "samesite", shown.alias("issues"))
