"""The whole audit of captured targets.

One pass reads the page and script text. It leaves one narrow row per resource with the hits of every
module as arrays; that table is written once to the shared folder. Everything behind it (caps,
de-duplication, joins with headers and responses, counts, grade, digest) reads only the columns it needs
of the narrow table, so the text is neither scanned again per module nor shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.functions import matching
from sitewarden.functions.words import MARK
from sitewarden.operators import acquisition as acq
from sitewarden.operators import cookies, fingerprint, forms, frontier, headers, javascript, leaks, responses, rollup
from sitewarden.operators import secrets as sec
from sitewarden.operators import tool_reports as tools
from sitewarden.rules import javascript as js_rules
from sitewarden.rules import leaks as leak_rules
from sitewarden.sources import sinks

SCRIPT_OFFSET = 10_000_000
KNOWN_SCRIPTS, BODIES, ARCHIVES = SCRIPT_OFFSET, 2 * SCRIPT_OFFSET, 3 * SCRIPT_OFFSET


@dataclass
class Captured:
    """Input tables of an audit. Tables that were not captured stay None and their modules are left out."""

    pages: DataFrame
    page_meta: DataFrame | None = None
    http_header: DataFrame | None = None
    set_cookie: DataFrame | None = None
    http_response: DataFrame | None = None
    scripts: DataFrame | None = None
    resource_body: DataFrame | None = None
    archive_index: DataFrame | None = None
    tool_report: DataFrame | None = None
    cert: DataFrame | None = None
    dns_record: DataFrame | None = None
    whois: DataFrame | None = None


def page_resources(pages: DataFrame) -> DataFrame:
    """Each page and its inline scripts and styles as resource rows; the page row carries the links."""
    parsed = pages.select(
        F.col("page_id").alias("target_id"), "html", acq.resources(F.col("html"), F.col("url")).alias("_parts")
    )
    parts = F.coalesce(F.col("_parts"), F.expr("array()"))
    links = F.transform(
        F.filter(parts, lambda r: r["external"]),
        lambda r: F.struct(r["kind"].alias("kind"), r["url"].alias("url")),
    )
    page = F.struct(
        F.lit(0).cast("bigint").alias("seq"), F.lit("html").alias("kind"), F.lit("HTML page").alias("url"),
        F.col("html").alias("content"), links.alias("links"),
    )
    inline = F.transform(
        F.filter(parts, lambda r: ~r["external"]),
        lambda r: F.struct(
            r["seq"].alias("seq"), r["kind"].alias("kind"), r["url"].alias("url"), r["content"].alias("content"),
            F.expr("CAST(NULL AS ARRAY<STRUCT<kind: STRING, url: STRING>>)").alias("links"),
        ),
    )
    return parsed.select("target_id", F.inline(F.concat(F.array(page), inline)))


def _rows(table: DataFrame, kind: Column, offset: int, order: Column) -> DataFrame:
    return table.select(
        "target_id", (order + offset).cast("bigint").alias("seq"), kind.alias("kind"), "url", "content",
        F.expr("CAST(NULL AS ARRAY<STRUCT<kind: STRING, url: STRING>>)").alias("links"),
    )


def facts(resources: DataFrame) -> DataFrame:
    """One narrow row per resource with the hits of all modules. A module runs only on texts that hold one
    of its words."""
    keys = ["target_id", "seq", "kind", "url"]
    content = F.col("content")
    page, script = F.col("kind") == "html", F.col("kind") != "html"  # style sheets drop out by kind later

    def given(words: list[str], value: Column, kind: Column | None = None) -> Column:
        mark = F.expr(matching.WORDS.present(words))
        return F.when(mark if kind is None else kind & mark, value)

    config_words = [word for _, _, word in leak_rules.CONFIG_BLOBS]
    marked = matching.WORDS.mark(resources.select(*keys, "links", "content"), "content")
    matched = marked.select(
        *keys,
        "links",
        "content",
        MARK,
        matching.credential_matches("content").alias("_matches"),
        matching.builder_patterns("content").alias("_builders"),
        given(config_words, leaks.config_blobs(content, F.lower(content)), page).alias("_blobs"),
    )
    return matched.select(
        *keys,
        "links",
        F.length("content").cast("bigint").alias("size"),
        matching.credential_hits(content, F.col("_matches")).alias("secrets"),
        F.when(page, matching.technologies("content")).alias("technologies"),
        fingerprint.with_evidence(content, F.col("_builders")).alias("builders"),
        leaks.config_findings(F.col("_blobs")).alias("config_findings"),
        given(["<!--"], leaks.comments(content), page).alias("comments"),
        given(["sourcemappingurl="], leaks.source_maps(content)).alias("source_maps"),
        given(leak_rules.ERROR_WORDS, leaks.debug_texts(content), page).alias("debug_texts"),
        given(["<form"], forms.parse(content), page).alias("forms"),
        given(["<meta"], fingerprint.metas(content), page).alias("metas"),
        given(["github.com/"], fingerprint.repos(content)).alias("repos"),
        given([*js_rules.SINKS, "fetch", ".open"], javascript.script_findings(content), script).alias("script_findings"),
        given(["__next_data__"], acq.build_id(content), script).alias("build_id"),
        given(["/static/"], acq.static_references(content), script).alias("refs"),
        F.when(acq.is_manifest(F.col("url")), acq.manifest_paths(content)).alias("paths"),
    )


@dataclass
class Audit:
    """Results of an audit; each frame is evaluated on use from the written facts."""

    targets: DataFrame
    facts: DataFrame
    folder: str
    modules: dict[str, DataFrame] = field(default_factory=dict)
    technologies: DataFrame | None = None
    #: Results that are no findings: inventory, meta, wordpress, errors, and certificates, dns, whois where captured.
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @cached_property
    def findings(self) -> DataFrame:
        """All findings, written on first use; counts and grades read the written table."""
        return sinks.materialize(rollup.findings_union(self.modules), f"{self.folder}/findings")

    def drop(self) -> None:
        """Delete the intermediate tables; the frames of this audit cannot be evaluated afterwards."""
        sinks.delete(self.targets.sparkSession, self.folder)

    @property
    def counts(self) -> DataFrame:
        return rollup.severity_counts(self.findings, self.targets)

    @property
    def grades(self) -> DataFrame:
        return rollup.grade(self.counts)


@dataclass
class Scanned:
    """Facts of the pages and known scripts, those of all resources of the targets, and the counts of resources."""

    own: DataFrame
    found: DataFrame
    inventory: DataFrame


def _reached(own: DataFrame, linked: DataFrame, body_facts: DataFrame, targets: DataFrame, folder: str) -> DataFrame:
    """Addresses of the captured bodies that a target refers to, at most two steps from the page.

    The bodies were scanned where they lie; only addresses and hits take part in these joins.
    """
    sites = frontier.sites_of(targets)
    ids = acq.first_build_id(own.filter(F.col("url") == "inline").select("target_id", "seq", "build_id"))
    linked = linked.unionByName(frontier.manifest_addresses(ids, sites))
    named = own.filter((F.col("kind") == "js") & F.col("refs").isNotNull())
    return frontier.discover(linked, named, body_facts, sites, f"{folder}/frontier", known=own)


def scan(captured: Captured, folder: str) -> Scanned:
    """Write the facts of the pages, of the known scripts and of what the targets refer to."""
    resources = page_resources(captured.pages)
    if captured.scripts is not None:
        resources = resources.unionByName(_rows(captured.scripts, F.lit("js"), KNOWN_SCRIPTS, F.col("seq")))
    own = found = sinks.materialize(facts(resources), f"{folder}/facts")
    targets = captured.pages.select(F.col("page_id").alias("target_id"), "url")
    linked = own.select("target_id", F.explode("links").alias("l")).select("target_id", "l.url", "l.kind")
    parts = own.filter(F.col("kind") != "html").select("target_id", "kind", "size")
    if captured.resource_body is not None:
        bodies = _rows(acq.captured(captured.resource_body), acq.kind_of(F.col("url")), BODIES, F.lit(0))
        body_facts = sinks.materialize(facts(bodies), f"{folder}/body_facts")
        addresses = _reached(own, linked, body_facts, targets, folder)
        reached = body_facts.drop("kind").join(addresses.select(*frontier.ON, "kind"), frontier.ON)
        found = found.unionByName(sinks.materialize(reached.select(body_facts.columns), f"{folder}/reached"))
        parts = parts.unionByName(frontier.fetched(linked, addresses, body_facts))
    inventory = acq.inventory_of(own.filter(F.col("kind") == "html").select("target_id", "size"), linked, parts)
    if captured.archive_index is not None:
        order = F.coalesce(F.col("ts").try_cast("bigint"), F.xxhash64("ts"))
        picked = acq.archive_select(captured.archive_index).select("target_id", "ts", "original")
        scripts = captured.archive_index.filter(F.col("mimetype") == acq.ARCHIVE_MIME)
        # Addresses decide before any pattern runs; only the picked scripts are scanned.
        bodies = acq.captured(scripts).join(picked, ["target_id", "ts", "original"], "left_semi")
        bodies = bodies.withColumn("url", acq.archive_label())
        archive = sinks.materialize(facts(_rows(bodies, F.lit("js"), ARCHIVES, order)), f"{folder}/archive_facts")
        found = found.unionByName(archive)
    return Scanned(own, found, inventory)


def run(captured: Captured, folder: str) -> Audit:
    """Audit the captured targets; ``folder`` is a fresh path in shared storage."""
    targets = captured.pages.select(F.col("page_id").alias("target_id"), "url")
    scanned = scan(captured, folder)
    found = scanned.found
    pages = scanned.own.filter(F.col("kind") == "html")  # pages are never reached as bodies

    technologies = pages.select("target_id", F.explode("technologies").alias("technology"))
    place = F.when(F.col("kind") == "html", F.lit(0)).otherwise(F.lit(3)).alias("source")
    builders = found.select("target_id", place, F.inline("builders"))
    if captured.http_header is not None:
        texts = fingerprint.header_texts(captured.http_header)
        technologies = technologies.unionByName(fingerprint.tech_detect(texts))
        builders = builders.unionByName(fingerprint.builder_hits(texts))
    if captured.page_meta is not None:
        builders = builders.unionByName(fingerprint.builder_hits(fingerprint.address_texts(captured.page_meta)))

    modules = {"transport": headers.transport_audit(targets)}
    if captured.http_header is not None:
        modules["headers"] = headers.header_missing(headers.header_audit(targets, captured.http_header))
        modules["header_leaks"] = headers.header_info_leak(captured.http_header)
    modules["builders"] = fingerprint.best_builders(builders)
    modules["secrets"] = sec.findings_of(sec.match_rows_of(found))
    if captured.http_response is not None:
        modules["paths"] = responses.path_exposure(captured.http_response)
    if captured.set_cookie is not None:
        modules["cookies"] = cookies.cookie_audit(cookies.cookie_parse(captured.set_cookie))
    modules["forms"] = forms.form_audit(forms.form_rows_of(pages.select("target_id", "forms")))
    modules["leaks"] = leaks.leaks_of(found)
    modules["js"] = javascript.js_dedup(javascript.js_findings_of(found.filter(F.col("kind") == "js")))
    if captured.http_response is not None:
        columns = ["target_id", "type", "url", "description", "severity"]
        modules["api"] = responses.openapi_audit(captured.http_response, targets).select(columns).unionByName(
            responses.graphql_audit(captured.http_response, targets).select(columns)
        )
    metas = fingerprint.meta_rows_of(pages.select("target_id", "metas"))
    wordpress = fingerprint.wordpress_flag(targets, metas, technologies.distinct())
    tables = {"inventory": scanned.inventory, "meta": fingerprint.meta_extract(metas), "wordpress": wordpress}
    if captured.tool_report is not None:
        # Reports count where their subject was seen: WordPress, or a repository link.
        flagged = targets.join(wordpress.filter("wordpress"), "target_id")
        repos = fingerprint.repo_rows_of(found.select("target_id", "repos"))
        wp_lines = tools.at_sites(tools.wp_lines(captured.tool_report), flagged)
        git_lines = tools.at_sites(tools.git_lines(captured.tool_report), tools.last_repository(repos))
        wp, git = tools.wp_report_findings(wp_lines), tools.git_report_findings(git_lines)
        modules["wp"] = wp.unionByName(tools.wp_report_clean(wp_lines, wp))
        modules["git"] = git.unionByName(tools.git_report_fallback(repos, git))
    if captured.cert is not None:
        tables["certificates"] = headers.cert_inventory(captured.cert)
    if captured.dns_record is not None:
        tables["dns"] = headers.dns_rollup(captured.dns_record)
    if captured.whois is not None:
        tables["whois"] = headers.whois_rows(captured.whois)
    return Audit(targets, found, folder, modules, technologies.distinct(), tables)


def digest(audit: Audit, captured: Captured) -> DataFrame:
    """Text summaries; needs headers, responses and cookies."""
    return rollup.target_digest(
        audit.targets, audit.technologies, audit.modules["secrets"], audit.modules["js"], audit.modules["paths"],
        audit.modules["headers"], cookies.insecure_cookie_count(cookies.cookie_parse(captured.set_cookie)),
    )
