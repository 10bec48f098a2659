"""Address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewarden.functions.text import strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
BASE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)"


def normalize(raw: Column) -> Column:
    """Trim, default to https, drop trailing slashes; an empty input stays empty."""
    text = strip(raw)
    full = F.when(F.rlike(text, F.lit("(?i)^https?://")), text).otherwise(F.concat(F.lit("https://"), text))
    return F.when(text == "", F.lit("")).otherwise(F.regexp_replace(full, r"/+$", ""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, BASE, 2)


def hostname(url: Column) -> Column:
    """Host without user, port and brackets, in lower case."""
    host = F.regexp_replace(netloc(url), r"^.*@", "")
    bare = F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)", 1)).otherwise(
        F.regexp_extract(host, r"^([^:]*)", 1)
    )
    return F.lower(bare)


def base(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(part == ".", acc)
        .otherwise(F.concat(acc, F.array(part))),
    )
    tail = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    joined = F.array_join(kept, "/")
    return F.concat(F.lit("/"), joined, F.when(joined == "", F.lit("")).otherwise(tail))


def resolve(base_url: Column, ref: Column) -> Column:
    """Join a reference with the address of the page that holds it."""
    no_fragment = F.regexp_replace(base_url, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    site = base(base_url)
    page_path = F.regexp_replace(no_query, BASE, "")
    folder = F.regexp_replace(page_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    rest = F.regexp_replace(ref, r"^[^?#]*", "")
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    folded = F.when(F.rlike(merged, F.lit(r"/\.\.?(?:/|$)")), _fold_dots(merged)).otherwise(merged)
    return (
        F.when(F.rlike(ref, F.lit(SCHEME)), ref)
        .when(ref.startswith("//"), F.concat(scheme(base_url), F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .when(ref.startswith("?"), F.concat(no_query, ref))
        .when(ref == "", base_url)
        .otherwise(F.concat(site, folded, rest))
    )
