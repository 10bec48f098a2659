"""From captured pages to the set of resources of a target.

Link discovery has a fixed depth of two, so it is a chain of joins: page -> references -> bodies ->
references inside bodies -> bodies. Windows and anti-joins run on addresses; a body is touched by the
scan that reads it and by one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import html, urls
from sitewarden.functions.frames import first_k
from sitewarden.functions.text import bind, extract_all, found
from sitewarden.rules import javascript as js

ARCHIVE_MIME = "application/javascript"
ARCHIVE_LABEL = "[ARCHIVE] "


def target_normalize(raw: DataFrame, column: str = "url") -> DataFrame:
    return raw.withColumn("normalized", urls.normalize(F.col(column)))


def url_parts(targets: DataFrame, column: str = "url") -> DataFrame:
    url = F.col(column)
    return targets.select(
        "*",
        urls.scheme(url).alias("scheme"),
        urls.hostname(url).alias("host"),
        urls.netloc(url).alias("netloc"),
        urls.base(url).alias("base"),
    )


def url_resolve(refs: DataFrame) -> DataFrame:
    return refs.select("target_id", "ref", urls.resolve(F.col("base_url"), F.col("ref")).alias("url"))


def redirect_flag(page_meta: DataFrame) -> DataFrame:
    return page_meta.select("target_id", "url", "final_url", (F.col("final_url") != F.col("url")).alias("redirected"))


def resources(page: Column, page_url: Column) -> Column:
    """``array<struct<seq, kind, external, url, content>>``: scripts and style sheets of a page.

    External ones carry the resolved address, inline ones the body. Style elements follow the linked
    sheets, as in the scan order.
    """
    parsed = F.transform(
        html.elements(page, "script", "style", "link"),
        lambda t, i: F.struct(
            i.alias("pos"),
            F.lower(F.regexp_extract(t, r"^<([A-Za-z]+)", 1)).alias("tag"),
            html.attributes(t, "src", "href", "rel").alias("a"),
            t.alias("text"),
        ),
    )

    def reference(e: Column) -> Column:
        sheet = (e["tag"] == "link") & F.array_contains(F.split(F.coalesce(e["a"]["rel"], F.lit("")), r"\s+"), "stylesheet")
        raw = F.when(e["tag"] == "script", e["a"]["src"]).when(sheet, e["a"]["href"])
        return F.nullif(raw, F.lit(""))

    def classified(e: Column) -> Column:
        return bind(
            reference(e),
            lambda ref: F.struct(
                (e["pos"] + F.when(e["tag"] == "style", F.lit(1_000_000)).otherwise(F.lit(0))).cast("bigint").alias("seq"),
                F.when(e["tag"] == "script", F.lit("js")).otherwise(F.lit("css")).alias("kind"),
                ref.isNotNull().alias("external"),
                F.coalesce(urls.resolve(page_url, ref), F.lit("inline")).alias("url"),
                F.when(ref.isNull() & (e["tag"] != "link"), F.nullif(html.body(e["text"]), F.lit(""))).alias("content"),
            ),
        )

    kept = F.filter(F.transform(parsed, classified), lambda r: r["external"] | r["content"].isNotNull())
    return F.when(found(page, r"(?i)<(?:script|style|link)"), kept)


def resource_extract(pages: DataFrame) -> DataFrame:
    """One row per script or style sheet, in document order."""
    return pages.select(
        F.col("page_id").alias("target_id"), F.inline(resources(F.col("html"), F.col("url")))
    )


def inline_resources(extracted: DataFrame) -> DataFrame:
    return extracted.filter(~F.col("external")).select("target_id", "seq", "kind", "url", "content")


def captured(bodies: DataFrame, min_length: int | None = None) -> DataFrame:
    ok = bodies.filter(F.col("status") == 200)
    return ok if min_length is None else ok.filter(F.length("content") > min_length)


def resource_join(refs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies of referenced resources that were answered with 200."""
    return refs.join(captured(bodies).select("target_id", "url", "content"), ["target_id", "url"])


def resource_inventory(pages: DataFrame, extracted: DataFrame, fetched: DataFrame) -> DataFrame:
    """Counts and total size per target; ``extracted (target_id, kind, external, size)`` are the parts of the pages,
    ``fetched (target_id, kind, size)`` the bodies of linked and discovered resources."""
    sizes = pages.select(F.col("page_id").alias("target_id"), F.length("html").cast("bigint").alias("size"))
    return inventory_of(
        sizes, extracted.filter("external").select("target_id", "kind"),
        extracted.filter("NOT external").select("target_id", "kind", "size").unionByName(fetched.select("target_id", "kind", "size")),
    )


def inventory_of(pages: DataFrame, links: DataFrame, bodies: DataFrame) -> DataFrame:
    """One aggregate over ``pages (target_id, size)``, ``links (target_id, kind)`` and ``bodies (target_id, kind, size)``."""
    none = F.lit(0).cast("bigint")
    rows = pages.select("target_id", F.lit("page").alias("part"), "size")
    rows = rows.unionByName(links.select("target_id", F.concat(F.lit("ref_"), F.col("kind")).alias("part"), none.alias("size")))
    rows = rows.unionByName(bodies.select("target_id", F.col("kind").alias("part"), (F.col("size") + 1).alias("size")))

    def count(part: str) -> Column:
        return F.count_if(F.col("part") == part)

    return rows.groupBy("target_id").agg(
        count("ref_js").alias("n_scripts"),
        count("ref_css").alias("n_stylesheets"),
        count("js").alias("js_count"),
        count("css").alias("css_count"),
        F.sum("size").alias("total_source_size"),
    )


def build_id(content: Column) -> Column:
    """Build id of a script that names the framework data, else null."""
    return F.when(
        F.contains(content, F.lit("__NEXT_DATA__")) & found(content, js.BUILD_ID),
        F.regexp_extract(content, js.BUILD_ID, 1),
    )


def manifest_paths(content: Column, limit: int | None = None) -> Column:
    """``array<string>``: the chunk paths of a build manifest."""
    found_paths = F.concat(*[extract_all(content, p, 1) for p in js.MANIFEST_CHUNKS])
    return found_paths if limit is None else F.slice(found_paths, 1, limit)


def static_references(content: Column) -> Column:
    """``array<string>``: distinct static files named inside a script."""
    return F.when(
        F.contains(content, F.lit("/static/")), F.array_distinct(extract_all(content, js.STATIC_REFERENCE, 1))
    )


def is_manifest(url: Column) -> Column:
    return url.endswith("/_buildManifest.js")


def nextjs_build_id(scripts: DataFrame) -> DataFrame:
    """First build id among the inline scripts of a target."""
    return first_build_id(
        scripts.filter(F.col("url") == "inline").select("target_id", "seq", build_id(F.col("content")).alias("build_id"))
    )


def first_build_id(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("build_id").isNotNull()).groupBy("target_id").agg(
        F.min_by("build_id", "seq").alias("build_id")
    )


def chunk_addresses(manifests: DataFrame) -> DataFrame:
    """Distinct resolved addresses of manifest rows ``(target_id, url, paths)``."""
    rows = manifests.select("target_id", urls.base(F.col("url")).alias("base"), F.explode("paths").alias("p"))
    path, site = F.col("p"), F.col("base")
    address = (
        F.when(path.startswith("http"), path)
        .when(path.startswith("/"), F.concat(site, path))
        .when(path.startswith("static/"), F.concat(site, F.lit("/_next/"), path))
        .otherwise(F.concat(site, F.lit("/_next/static/"), path))
    )
    return rows.select("target_id", address.alias("url")).distinct()


def chunk_manifest_refs(scripts: DataFrame) -> DataFrame:
    return chunk_addresses(
        scripts.filter(is_manifest(F.col("url"))).select("target_id", "url", manifest_paths(F.col("content")).alias("paths"))
    )


def unseen(refs: DataFrame, seen: DataFrame) -> DataFrame:
    """Addresses that are not known yet. Known ones are reduced to one row each before the join: a target
    may have any number of rows with the address ``inline``."""
    known = seen.filter(~F.col("url").isin("inline", "HTML page")).select("target_id", "url").distinct()
    return refs.join(known, ["target_id", "url"], "left_anti")


def chunk_resources(scripts: DataFrame, bodies: DataFrame, min_length: int | None = None) -> DataFrame:
    """Captured bodies of manifest chunks that are not known yet."""
    return (
        unseen(chunk_manifest_refs(scripts), scripts)
        .join(captured(bodies, min_length).select("target_id", "url", "content"), ["target_id", "url"])
        .withColumn("kind", F.lit("js"))
    )


def frontier_addresses(rows: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """Unseen addresses of ``(target_id, base, refs)``; ``limit`` keeps the first ones of a target in order."""
    refs = rows.select("target_id", "base", F.explode("refs").alias("path")).select(
        "target_id", F.concat("base", "path").alias("url")
    )
    fresh = unseen(refs.distinct(), seen)
    return fresh if limit is None else first_k(fresh, ["target_id"], ["url"], limit)


def kind_of(url: Column) -> Column:
    return F.when(url.endswith(".css"), F.lit("css")).otherwise(F.lit("js"))


def referenced_js_frontier(
    scripts: DataFrame, base: Column, bodies: DataFrame, limit: int | None = None, min_length: int | None = None
) -> DataFrame:
    """Captured bodies of static files named inside scripts; ``.css`` goes to the style sheets."""
    rows = scripts.select("target_id", base.alias("base"), static_references(F.col("content")).alias("refs"))
    return (
        frontier_addresses(rows, scripts, limit)
        .join(captured(bodies, min_length).select("target_id", "url", "content"), ["target_id", "url"])
        .withColumn("kind", kind_of(F.col("url")))
    )


def archive_select(index: DataFrame, limit: int | None = None) -> DataFrame:
    """Index rows to fetch: scripts, the earliest of each key; ``limit`` keeps the first keys of a target."""
    rows = index.filter((F.col("mimetype") == ARCHIVE_MIME) & (F.col("ts") != "timestamp")).select(
        "target_id", "ts", "original", "urlkey"
    )
    earliest = first_k(rows, ["target_id", "urlkey"], ["ts", "original"], 1)
    return earliest if limit is None else first_k(earliest, ["target_id"], ["urlkey"], limit)


def archive_label() -> Column:
    return F.concat(F.lit(ARCHIVE_LABEL), "original")


def archive_resources(selected: DataFrame, bodies: DataFrame, min_length: int | None = None) -> DataFrame:
    """Archived bodies as labelled script resources."""
    kept = captured(bodies, min_length).select("target_id", "ts", "original", "content")
    return selected.select("target_id", "ts", "original").join(kept, ["target_id", "ts", "original"]).select(
        "target_id", "ts", archive_label().alias("url"), "content"
    )
