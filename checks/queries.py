"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import planted_html, relation
from sitewarden.operators import acquisition as acq
from sitewarden.operators import cookies, fingerprint, forms, frontier, headers, history, javascript, leaks, responses, rollup
from sitewarden.operators import secrets as sec
from sitewarden.operators import tool_reports as tools
from sitewarden.plans import audit
from sitewarden.rules import report
from sitewarden.sources import sinks
from sitewarden.sources.captured import page_resources, page_source, read_table, stream_table
from sitewarden.streaming import scan as stream

Query = Callable[[SparkSession, str], DataFrame]
FIXTURE_BASE = "https://x.example.com"
QUERIES: dict[str, Query] = {}


def query(fn: Callable[["Inputs"], DataFrame]) -> Callable[["Inputs"], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return fn


class Inputs:
    """Relations of one data directory, each built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(Inputs, "make_" + name)(self) if hasattr(Inputs, "make_" + name) else (
                relation(self.spark, self.sf_dir, name)
            )
        return self._made[name]

    def make_pages(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "pages")

    def make_targets(self) -> DataFrame:
        return self.pages.select(F.col("page_id").alias("target_id"), "url")

    def make_page_rows(self) -> DataFrame:
        return page_resources(self.planted_pages)

    def make_extracted(self) -> DataFrame:
        return acq.resource_extract(self.planted_pages)

    def make_live(self) -> DataFrame:
        """Pages, then their inline scripts and styles."""
        return audit.page_resources(self.planted_pages).drop("links")

    def make_documents(self) -> DataFrame:
        """Prose as further page texts, numbered below zero to stay apart from the pages."""
        return read_table(self.spark, self.sf_dir, "documents").select(
            (-F.col("doc_id") - 1).alias("target_id"),
            F.lit(0).cast("bigint").alias("seq"),
            F.lit("html").alias("kind"),
            F.lit("HTML page").alias("url"),
            F.col("text").alias("content"),
        )

    def make_page_matches(self) -> DataFrame:
        return sec.secret_matches(self.page_rows)

    def make_page_findings(self) -> DataFrame:
        return sec.findings_of(self.page_matches)

    def make_archived(self) -> DataFrame:
        index = self.archive_index
        return acq.archive_resources(acq.archive_select(index), index)

    def make_technologies(self) -> DataFrame:
        return fingerprint.tech_detect(
            fingerprint.page_texts(self.planted_pages), fingerprint.header_texts(self.http_header)
        )

    def make_builders(self) -> DataFrame:
        return fingerprint.builder_detect(
            fingerprint.page_texts(self.planted_pages),
            fingerprint.header_texts(self.http_header),
            fingerprint.address_texts(self.page_meta),
        )

    def make_form_rows(self) -> DataFrame:
        return forms.page_forms(self.planted_pages)

    def make_metas(self) -> DataFrame:
        return fingerprint.page_metas(self.planted_pages)

    def make_audit_headers(self) -> DataFrame:
        return headers.header_audit(self.targets, self.http_header)

    def make_cookies(self) -> DataFrame:
        return cookies.cookie_parse(self.set_cookie)

    def make_scripts_found(self) -> DataFrame:
        return javascript.js_dedup(javascript.js_findings(self.resource_js))

    def make_exposures(self) -> DataFrame:
        return responses.path_exposure(self.http_response)

    def make_reports_at_sites(self) -> DataFrame:
        return tools.at_sites(self.tool_report, self.targets)

    def make_wp(self) -> DataFrame:
        return tools.wp_report_findings(self.reports_at_sites)

    def make_git(self) -> DataFrame:
        return tools.git_report_findings(self.reports_at_sites)

    def make_captured(self) -> audit.Captured:
        return audit.Captured(
            pages=self.planted_pages, page_meta=self.page_meta, http_header=self.http_header,
            set_cookie=self.set_cookie, http_response=self.http_response, scripts=self.resource_js,
            resource_body=self.resource_body, archive_index=self.archive_index, tool_report=self.tool_report,
            cert=self.cert, dns_record=self.dns_record, whois=self.whois,
        )

    def make_audit(self) -> audit.Audit:
        return audit.run(self.captured, sinks.shared_folder(self.spark))

    def make_counts(self) -> DataFrame:
        return self.audit.counts


# --- sources, addresses, resources ---------------------------------------------------------------


@query
def page_source_(i):
    meta = i.page_meta.join(i.pages.select(F.col("page_id").alias("target_id"), "html"), "target_id")
    return page_source(meta)


@query
def target_normalize(i):
    raw = i.pages.select(
        F.col("page_id").alias("target_id"),
        F.concat(F.lit("  "), F.regexp_replace("url", "^http://", ""), F.lit("// ")).alias("url"),
    )
    return acq.target_normalize(raw).select("target_id", "normalized")


@query
def url_parts(i):
    return acq.url_parts(i.targets).select("target_id", "scheme", "host", "netloc", "base")


@query
def url_resolve(i):
    return acq.url_resolve(i.resource_ref)


@query
def redirect_flag(i):
    return acq.redirect_flag(i.page_meta)


@query
def resource_extract(i):
    return i.extracted


@query
def resource_join(i):
    joined = acq.resource_join(acq.url_resolve(i.resource_ref), i.resource_body)
    return joined.select("target_id", "url", F.length("content").cast("bigint").alias("size"))


@query
def resource_inventory(i):
    return frontier.inventory(i.planted_pages, i.extracted, i.resource_body, sinks.shared_folder(i.spark))


@query
def audit_resources(i):
    """The same counts from the facts of the audit, known scripts included."""
    return i.audit.tables["inventory"]


@query
def nextjs_build_id(i):
    inline = acq.inline_resources(i.extracted).filter(F.col("kind") == "js")
    return acq.nextjs_build_id(
        inline.select("target_id", "seq", "url", "content").unionByName(i.build_script)
    )


@query
def chunk_manifest_refs(i):
    kept = acq.chunk_resources(i.resource_js, i.resource_body)
    return kept.select("target_id", "url", "kind", F.length("content").cast("bigint").alias("size"))


@query
def referenced_js_frontier(i):
    kept = acq.referenced_js_frontier(i.resource_js, F.lit(FIXTURE_BASE), i.resource_body)
    return kept.select("target_id", "url", "kind", F.length("content").cast("bigint").alias("size"))


@query
def archive_select(i):
    return acq.archive_select(i.archive_index)


@query
def archive_resources(i):
    return i.archived.select("target_id", "ts", "url", F.length("content").cast("bigint").alias("size"))


@query
def historical_only_secrets(i):
    archived = i.archived.select(
        "target_id", F.col("ts").cast("bigint").alias("seq"), F.lit("js").alias("kind"), "url", "content"
    )
    return sec.historical_only(i.page_matches, sec.secret_matches(archived))


@query
def secret_lifetimes(i):
    copies = history.readable_copies(i.archive_history)
    return history.secret_lifetimes(copies, sec.secret_matches(copies), i.page_matches)


@query
def findings_sink(i):
    folder = sinks.shared_folder(i.spark)
    sinks.write_findings(i.page_findings, folder)
    return i.spark.read.parquet(folder).select("target_id", "type", "value_masked", "severity")


# --- credential scan -----------------------------------------------------------------------------


@query
def secret_matches(i):
    return i.page_matches.groupBy("target_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def secret_match_cap(i):
    return sec.apply_cap(i.page_matches).groupBy("target_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query
def secret_context(i):
    return i.page_matches.select("target_id", "rule", "pos", F.md5("context").alias("context_hash"))


@query
def fp_global(i):
    return i.page_matches.select("target_id", "rule", "pos", sec.global_suppressor().alias("suppressed"))


@query
def fp_by_rule(i):
    return i.page_matches.select("target_id", "rule", "pos", sec.rule_suppressor().alias("suppressed_by"))


@query
def secret_location(i):
    return sec.secret_locations(sec.secret_matches(i.live))


@query
def secret_mask(i):
    return i.page_matches.select("target_id", "rule", "pos", sec.masked().alias("value_masked"))


@query
def secret_severity(i):
    return i.page_matches.select("rule", sec.rule_severity(F.col("rule")).alias("severity")).distinct()


@query
def secret_dedup(i):
    rows = sec.dedup(sec.to_findings(i.page_matches))
    return rows.select("target_id", "type", "value_masked", "pos")


@query
def secret_full(i):
    """The flagship: live resources of all pages and all documents through the whole chain."""
    return sec.secret_findings(i.live.unionByName(i.documents))


@query
def secret_counts(i):
    return sec.secret_counts(i.page_findings)


# --- fingerprints --------------------------------------------------------------------------------


@query
def tech_detect(i):
    return i.technologies


@query
def meta_extract(i):
    return fingerprint.meta_extract(i.metas).select("target_id", "name", "content")


@query
def wordpress_flag(i):
    return fingerprint.wordpress_flag(i.targets, i.metas, i.technologies)


@query
def repo_links(i):
    return fingerprint.repo_links(i.planted_pages)


@query
def repo_links_all(i):
    return fingerprint.repo_links(i.planted_pages, i.resource_js)


@query
def builder_detect_all(i):
    """Builders in script bodies too."""
    return fingerprint.builder_detect(
        fingerprint.page_texts(i.planted_pages), fingerprint.header_texts(i.http_header),
        fingerprint.address_texts(i.page_meta), fingerprint.script_texts(i.resource_js),
    )


@query
def tech_category(i):
    return fingerprint.tech_category(i.technologies)


@query
def builder_detect(i):
    return i.builders


@query
def builder_risk(i):
    return fingerprint.builder_risk(i.builders).select("target_id", "tool", "description", "risk")


@query
def builder_count(i):
    return fingerprint.builder_count(i.builders)


# --- headers, transport, registration ------------------------------------------------------------


@query
def header_audit(i):
    return i.audit_headers


@query
def header_missing(i):
    return headers.header_missing(i.audit_headers)


@query
def header_info_leak(i):
    return headers.header_info_leak(i.http_header)


@query
def transport_audit(i):
    return headers.transport_audit(i.targets)


@query
def cert_inventory(i):
    return headers.cert_inventory(i.cert)


@query
def dns_rollup(i):
    return headers.dns_rollup(i.dns_record)


@query
def report_topn_cert(i):
    return headers.cert_report_rows(i.cert)


@query
def report_topn_dns(i):
    return headers.dns_report_rows(i.dns_record)


@query
def whois_rows(i):
    return headers.whois_rows(i.whois)


# --- responses -----------------------------------------------------------------------------------


@query
def path_exposure(i):
    return i.exposures


@query
def path_verify(i):
    return i.http_response.select(
        "target_id", "path", responses.path_verified(F.col("path"), F.col("body")).alias("verified")
    )


@query
def path_severity(i):
    return i.http_response.select("target_id", "path", responses.path_severity(F.col("path")).alias("severity"))


@query
def path_snippet(i):
    return i.http_response.select(
        "target_id", "path", F.length("body").cast("bigint").alias("size"),
        responses.path_snippet(F.col("body")).alias("snippet"),
    )


@query
def openapi_audit(i):
    return responses.openapi_audit(i.http_response, i.targets)


@query
def graphql_audit(i):
    return responses.graphql_audit(i.http_response, i.targets)


# --- cookies and forms ---------------------------------------------------------------------------


@query
def cookie_parse(i):
    return i.cookies.drop("url")


@query
def cookie_audit(i):
    return cookies.cookie_audit(i.cookies)


@query
def insecure_cookie_count(i):
    return cookies.insecure_cookie_count(i.cookies)


@query
def form_extract(i):
    return forms.form_extract(i.form_rows)


@query
def form_audit(i):
    return forms.form_audit(i.form_rows)


# --- leaks ---------------------------------------------------------------------------------------


@query
def comment_leak(i):
    return leaks.comment_leak(i.planted_pages)


@query
def sourcemap_leak(i):
    return leaks.sourcemap_leak(i.live)


@query
def debug_leak(i):
    return leaks.debug_leak(i.planted_pages)


@query
def framework_config_blob(i):
    return leaks.framework_config_blob(i.planted_pages)


@query
def framework_config_keys(i):
    return leaks.framework_config_keys(i.planted_pages)


# --- scripts -------------------------------------------------------------------------------------


@query
def js_sinks(i):
    return javascript.js_sinks(i.resource_js).drop("ord")


@query
def js_api_calls(i):
    return javascript.js_api_calls(i.resource_js).drop("ord")


@query
def js_dedup(i):
    return i.scripts_found


@query
def js_pattern_counts(i):
    return javascript.js_pattern_counts(i.scripts_found)


# --- reports of other scanners -------------------------------------------------------------------


@query
def wp_report_findings(i):
    return i.wp


@query
def wp_report_clean(i):
    return tools.wp_report_clean(i.reports_at_sites, i.wp)


@query
def git_report_findings(i):
    return i.git


@query
def git_report_fallback(i):
    return tools.git_report_fallback(fingerprint.repo_links(i.linked_pages), i.git)


# --- roll-up -------------------------------------------------------------------------------------


@query
def findings_union(i):
    return i.audit.findings


@query
def severity_counts(i):
    return i.counts


@query
def severity_bars(i):
    return rollup.severity_bars(i.counts)


@query
def severity_rollup(i):
    return rollup.severity_rollup(i.counts, i.targets)


@query
def grade(i):
    return rollup.grade(i.counts)


@query
def remediation_join(i):
    return rollup.remediation_join(i.page_findings).select("target_id", "type", "value_masked", "advice")


@query
def path_remediation(i):
    return rollup.path_remediation(i.exposures).select("target_id", "path", "advice")


@query
def js_remediation(i):
    return rollup.js_remediation(javascript.js_pattern_counts(i.scripts_found))


@query
def target_digest(i):
    return audit.digest(i.audit, i.captured)


@query
def report_topn(i):
    return javascript.js_report_rows(i.scripts_found)


@query
def report_topn_meta(i):
    rows = fingerprint.meta_top(i.metas, report.META_ROWS)
    return rows.select("target_id", "n", "name", F.substring("content", 1, report.VALUE_WIDTH).alias("content"))


@query
def report_topn_forms(i):
    return forms.form_rows(i.form_rows)


@query
def report_topn_cookies(i):
    return cookies.cookie_rows(i.cookies)


@query
def report_topn_paths(i):
    return i.exposures.select("target_id", "path", F.substring("snippet", 1, report.SNIPPET_WIDTH).alias("preview"))


@query
def module_error_rows(i):
    bodies = responses.unreadable_bodies(responses.api_documents(i.http_response.unionByName(i.api_broken)))
    return rollup.module_error_rows(i.targets, tools.unreadable_lines(i.tool_report).unionByName(bodies))


# --- streaming -----------------------------------------------------------------------------------


def drained(i: Inputs) -> DataFrame:
    """The findings of the stream over the page files, read back from its sink."""
    files = stream_table(i.spark, i.sf_dir, "pages")
    planted = planted_html(files).withColumn(
        "captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    )
    rows = page_resources(planted, "captured_at")
    folder = sinks.shared_folder(i.spark)
    stream.drain(stream.scan_stream(rows, "1 day"), f"{folder}/sink", f"{folder}/progress")
    return stream.present(i.spark, f"{folder}/sink")


@query
def scan_stream(i):
    return drained(i).select("target_id", "type", "value_masked", "location", "context", "severity", "n_values")


@query
def severity_windows(i):
    rows = stream.severity_windows(drained(i), "1 hour")
    return rows.select(F.unix_timestamp("start").alias("start"), "severity", "n")


@query
def findings_stream_sink(i):
    """Rows per severity of the streaming sink: all versions of all findings."""
    folder = sinks.shared_folder(i.spark)
    files = stream_table(i.spark, i.sf_dir, "pages")
    planted = planted_html(files).withColumn("captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    stream.drain(stream.value_stream(page_resources(planted, "captured_at"), "1 day"), folder, f"{folder}/progress")
    return sinks.read_batches(i.spark, folder, f"{stream.VALUE}, batch int").select("target_id", "type", "value_masked", "location", "context", "severity")


QUERIES["page_source"] = QUERIES.pop("page_source_")
