"""Technologies, page metadata, repository links and site builders.

Page bodies and header rows are tested where they are and only names are combined, so a page is never
moved to its headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import html, matching
from sitewarden.functions.frames import first_k
from sitewarden.functions.text import extract_all, found, lookup
from sitewarden.rules import builders, tech


def _marked(texts: DataFrame) -> DataFrame:
    return matching.WORDS.mark(texts, "text")


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("target_id"), F.lit(0).alias("source"), F.col("html").alias("text"))


def header_texts(headers: DataFrame) -> DataFrame:
    shown = F.concat(F.lit("'"), F.col("name"), F.lit("': '"), F.col("value"), F.lit("'"))
    return headers.select("target_id", F.lit(1).alias("source"), shown.alias("text"))


def address_texts(page_meta: DataFrame) -> DataFrame:
    return page_meta.select("target_id", F.lit(2).alias("source"), F.col("final_url").alias("text"))


def script_texts(scripts: DataFrame) -> DataFrame:
    return scripts.select("target_id", F.lit(3).alias("source"), F.col("content").alias("text"))


def tech_detect(*texts: DataFrame) -> DataFrame:
    """Distinct technologies per target over the given texts."""
    names = [
        _marked(t).select("target_id", F.explode(matching.technologies("text")).alias("technology"))
        for t in texts
    ]
    return _union(names).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def metas(page: Column) -> Column:
    """``array<struct<name, property, content>>`` of the meta elements."""
    return F.when(
        found(page, "(?i)<meta"),
        F.transform(html.elements(page, "meta"), lambda t: html.attributes(t, "name", "property", "content")),
    )


def repos(page: Column) -> Column:
    """``array<string>``: distinct repository links of a page."""
    return F.when(
        F.contains(page, F.lit("github.com/")), F.array_distinct(extract_all(page, tech.REPO_LINK))
    )


def page_metas(pages: DataFrame) -> DataFrame:
    return meta_rows_of(pages.select(F.col("page_id").alias("target_id"), metas(F.col("html")).alias("metas")))


def meta_rows_of(parsed: DataFrame) -> DataFrame:
    """Named meta elements of ``(target_id, metas)`` in document order; ``name`` counts before ``property``."""
    rows = parsed.select("target_id", F.posexplode("metas").alias("pos", "m"))
    return rows.select(
        "target_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.coalesce("m.name", "m.property", F.lit("")).alias("name"),
        F.coalesce("m.content", F.lit("")).alias("content"),
        F.coalesce(F.col("m.name") == "generator", F.lit(False)).alias("is_generator"),
    ).filter(F.col("name") != "")


def meta_extract(metas: DataFrame) -> DataFrame:
    """Last value of each name. ``first_pos`` is the place of the name in the report: the generator leads."""
    first = F.when(F.max("is_generator"), F.lit(-1).cast("bigint")).otherwise(F.min("pos"))
    return metas.groupBy("target_id", "name").agg(
        F.max_by("content", "pos").alias("content"), first.alias("first_pos")
    )


def wordpress_flag(targets: DataFrame, metas: DataFrame, technologies: DataFrame) -> DataFrame:
    """WordPress by fingerprint or by the first generator element."""
    by_tech = technologies.filter(F.col("technology") == "WordPress").select("target_id", F.lit(True).alias("hit"))
    by_meta = (
        metas.filter("is_generator")
        .groupBy("target_id")
        .agg(F.contains(F.lower(F.min_by("content", "pos")), F.lit("wordpress")).alias("hit"))
    )
    everyone = targets.select("target_id", F.lit(False).alias("hit"))
    return everyone.unionByName(by_tech).unionByName(by_meta).groupBy("target_id").agg(
        F.bool_or("hit").alias("wordpress")
    )


def repo_links(pages: DataFrame, *bodies: DataFrame) -> DataFrame:
    """Repository links of pages and, if given, of script and style bodies ``(target_id, content)``."""
    texts = pages.select(F.col("page_id").alias("target_id"), F.col("html").alias("content"))
    texts = _union([texts, *[b.select("target_id", "content") for b in bodies]])
    return repo_rows_of(texts.select("target_id", repos(F.col("content")).alias("repos")))


def repo_rows_of(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """The distinct repository links of a target; ``limit`` keeps the first ones by name."""
    links = parsed.select("target_id", F.explode("repos").alias("repo")).distinct()
    return links if limit is None else first_k(links, ["target_id"], ["repo"], limit)


def tech_category(technologies: DataFrame) -> DataFrame:
    """Technologies per report category; at most the whole list of 29 per group."""
    of = {name: category for category, names in tech.CATEGORIES.items() for name in names}
    return (
        technologies.withColumn("category", lookup(F.col("technology"), of, "Other"))
        .groupBy("target_id", "category")
        .agg(F.array_join(F.sort_array(F.collect_set("technology")), ", ").alias("technologies"))
    )


def builder_hits(texts: DataFrame) -> DataFrame:
    tests = _marked(texts).select("target_id", "source", "text", matching.builder_patterns("text").alias("_hits"))
    return tests.select("target_id", "source", F.inline(with_evidence(F.col("text"), F.col("_hits"))))


def with_evidence(text: Column, hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["tool"].alias("tool"),
            h["n"].alias("n"),
            h["pattern"].alias("matched_pattern"),
            matching.evidence(text, h["pattern"]).alias("evidence"),
        ),
    )


def builder_detect(*texts: DataFrame) -> DataFrame:
    """One row per builder: its first fingerprint in list order, page before headers, address and script bodies."""
    return best_builders(_union([builder_hits(t) for t in texts]))


def best_builders(hits: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("matched_pattern", "evidence"), F.struct("n", "source", "evidence"))
    return (
        hits.groupBy("target_id", "tool")
        .agg(best.alias("b"))
        .select("target_id", "tool", "b.matched_pattern", "b.evidence")
    )


def about_builder(tool: Column) -> tuple[Column, Column]:
    return (
        lookup(tool, {t: d for t, (d, _) in builders.ABOUT.items()}),
        lookup(tool, {t: r for t, (_, r) in builders.ABOUT.items()}),
    )


def builder_risk(detected: DataFrame) -> DataFrame:
    description, risk = about_builder(F.col("tool"))
    return detected.withColumn("description", description).withColumn("risk", risk)


def builder_count(detected: DataFrame) -> DataFrame:
    return detected.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_builders"))


def meta_top(metas: DataFrame, k: int) -> DataFrame:
    return first_k(meta_extract(metas), ["target_id"], ["first_pos", "name"], k, rank="n")


