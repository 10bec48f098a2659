"""Which captured bodies a target refers to, found step by step.

Bodies name other addresses: build manifests list chunks, scripts name static files. The search is semi-naive: a step looks
only at the addresses that the step before added, joins them with what the bodies of these addresses name, and keeps what no
step has seen. Each step's addresses are a written table, so a step costs the new addresses and not the path to them, and
the plan does not grow with the depth. Only addresses take part; the bodies stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import urls
from sitewarden.operators import acquisition as acq
from sitewarden.sources import sinks

ON = ["target_id", "url"]
STEPS = 2


def body_links(bodies: DataFrame) -> DataFrame:
    """``(target_id, url, size, refs, paths)`` of the bodies that were answered with 200: what each names, in one pass."""
    content = F.col("content")
    return acq.captured(bodies).select(
        *ON, F.length(content).cast("bigint").alias("size"), acq.static_references(content).alias("refs"),
        F.when(acq.is_manifest(F.col("url")), acq.manifest_paths(content)).alias("paths"),
    )


def manifest_addresses(build_ids: DataFrame, sites: DataFrame) -> DataFrame:
    """Address of the build manifest of each target ``(target_id, build_id)``; ``sites`` is ``(target_id, base)``."""
    address = F.concat("base", F.lit("/_next/static/"), "build_id", F.lit("/_buildManifest.js"))
    return build_ids.join(sites, "target_id").select("target_id", address.alias("url"), F.lit("js").alias("kind"))


def sites_of(targets: DataFrame) -> DataFrame:
    return targets.select("target_id", urls.base(F.col("url")).alias("base"))


def discover(
    linked: DataFrame, named: DataFrame, bodies: DataFrame, sites: DataFrame, folder: str, steps: int = STEPS, known: DataFrame | None = None
) -> DataFrame:
    """``(target_id, url, kind, step)`` of every address found in at most ``steps`` steps, each once, at its first step.

    ``linked (target_id, url, kind)`` are the addresses a page refers to; they and the chunks that manifests among them list
    are the first step. ``named (target_id, refs)`` are the static files that scripts of the page name; they and those that
    scripts of a step name are the next step. ``bodies (target_id, url, refs, paths)`` are captured bodies. Addresses of
    ``known (target_id, url)`` are not found again.
    """
    columns = [*ON, "kind", "step"]

    def written(rows: DataFrame, step: int, name: str) -> DataFrame:
        return sinks.materialize(rows.withColumn("step", F.lit(step)).select(columns), f"{folder}/{name}")

    def behind(addresses: DataFrame) -> DataFrame:
        return bodies.select(*ON, "refs", "paths").join(addresses, ON)

    fresh = written(linked.groupBy(*ON).agg(F.max("kind").alias("kind")), 1, "linked")
    chunks = acq.chunk_addresses(behind(fresh).filter(F.col("paths").isNotNull())).withColumn("kind", F.lit("js"))
    chunks = written(_unseen(chunks, fresh, known), 1, "chunks")
    seen = fresh = fresh.unionByName(chunks)
    for step in range(2, steps + 1):
        sources = behind(fresh).filter(F.col("kind") == "js").select("target_id", "refs")
        sources = sources.unionByName(named.select("target_id", "refs")) if step == 2 else sources
        paths = sources.select("target_id", F.explode("refs").alias("path")).distinct()
        found = paths.join(sites, "target_id").select("target_id", F.concat("base", "path").alias("url"))
        found = found.withColumn("kind", acq.kind_of(F.col("url")))
        fresh = written(_unseen(found, seen, known), step, f"step-{step}")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


def _unseen(addresses: DataFrame, seen: DataFrame, known: DataFrame | None) -> DataFrame:
    names = seen.select(*ON)
    if known is not None:
        names = names.unionByName(known.select(*ON))
    return acq.unseen(addresses, names)


def inventory(pages: DataFrame, extracted: DataFrame, bodies: DataFrame, folder: str, steps: int = STEPS) -> DataFrame:
    """Counts and sizes per target with everything its page leads to: inline parts, linked and discovered bodies.

    ``pages (page_id, url, html)``, ``extracted`` as of ``resource_extract``, ``bodies (target_id, url, status, content)``.
    The page parts and the bodies are each read once into narrow tables.
    """
    content, inline_script = F.col("content"), (F.col("kind") == "js") & ~F.col("external")
    parts = sinks.materialize(extracted.select(
        "target_id", "seq", "kind", "external", "url", F.length(content).cast("bigint").alias("size"),
        F.when(inline_script, acq.static_references(content)).alias("refs"), F.when(inline_script, acq.build_id(content)).alias("build_id"),
    ), f"{folder}/parts")
    links = sinks.materialize(body_links(bodies), f"{folder}/body-links")
    sites = sites_of(pages.select(F.col("page_id").alias("target_id"), "url"))
    linked = parts.filter("external").select(*ON, "kind")
    manifests = manifest_addresses(acq.first_build_id(parts), sites)
    found = discover(linked.unionByName(manifests), parts.filter("refs IS NOT NULL"), links, sites, folder, steps)
    return acq.resource_inventory(pages, parts, fetched(linked, found, links))


def fetched(linked: DataFrame, found: DataFrame, bodies: DataFrame) -> DataFrame:
    """``(target_id, kind, size)``: a row per link with a captured body, and one per discovered body."""
    size = bodies.select(*ON, "size")
    discovered = found.select(*ON, "kind").join(linked.select(*ON).distinct(), ON, "left_anti")
    return linked.unionByName(discovered).join(size, ON).select("target_id", "kind", "size")
