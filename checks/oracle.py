"""The same results as ANSI-style SQL over the raw tables, for a second engine.

Each statement is put together from named common table expressions; only those it needs are included.
The fixed values come from the rule tables, the logic is written a second time.
"""

from __future__ import annotations

import re

from checks.fixtures import NUMBERED_SQL, RELATIONS
from sitewarden.functions.text import WHITE
from sitewarden.rules import (
    builders, headers, javascript, leaks, paths, remediation, report, secrets, tech,
)
from sitewarden.rules import false_positives as fp


def s(value) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def table(columns: list[str], rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(s(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {values}) v({', '.join(columns)})"


def strip(x: str) -> str:
    return f"trim({x}, {s(WHITE)})"


def line(x: str) -> str:
    return strip(f"replace({x}, chr(10), ' ')")


def any_word(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(w)})" for w in words) + ")"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {s(pattern)})"


CTE: dict[str, str] = dict(RELATIONS)
CTE["numbered"] = NUMBERED_SQL
CTE["targets"] = "SELECT page_id AS target_id, url FROM pages"

# --- credential scan -----------------------------------------------------------------------------

CTE["secret_rules"] = table(
    ["ord", "rule", "pattern", "severity"],
    [(n, r, p, secrets.severity(r)) for n, (r, p) in enumerate(secrets.PATTERNS.items(), 1)],
)
CTE["page_rows"] = (
    "SELECT page_id AS target_id, 0::BIGINT AS seq, 0 AS kind_ord, 'html' AS kind, 'HTML page' AS url, html AS content FROM planted_pages"
)
CTE["live"] = (
    "SELECT * FROM page_rows UNION ALL SELECT target_id, seq, CASE kind WHEN 'js' THEN 1 ELSE 2 END, kind, url, content FROM extracted WHERE NOT external"
)
CTE["live_and_documents"] = (
    "SELECT * FROM live UNION ALL SELECT -doc_id - 1, 0::BIGINT, 0, 'html', 'HTML page', text FROM documents"
)
CTE["archive_rows"] = (
    "SELECT target_id, ts::BIGINT AS seq, 1 AS kind_ord, 'js' AS kind, url, content FROM archived"
)

MASK = "CASE WHEN length(value) > 20 THEN left(value, 12) || '...' || right(value, 6) ELSE left(value, 6) || '****' END"
GLOBAL_FP = rx("context", "(?i)" + "|".join(fp.GLOBAL_CONTEXT))
RULE_FP = (
    f"CASE WHEN rule = 'IP Address (Private)' AND {rx('context', '(?i)' + fp.VERSION_CONTEXT)} THEN 'F1'"
    f" WHEN rule IN ('JWT Token', 'Supabase Key') AND {any_word('lower(context)', fp.STYLE_WORDS)} THEN 'F2'"
    f" WHEN rule = 'Google API Key' AND {any_word('value', fp.PLACEHOLDERS)} THEN 'F3'"
    " WHEN rule = 'Generic Secret' THEN CASE"
    f" WHEN {any_word('lower(regexp_extract(value, ' + s(secrets.PATTERNS['Generic Secret']) + ', 1))', fp.LABEL_WORDS)} THEN 'F4'"
    + "".join(f" WHEN {rx('context', ('(?i)' if fold else '') + p)} THEN '{n}'" for n, p, fold in fp.GENERIC_CONTEXT)
    + " END END"
)


#: The value as its mask, then every other match and what the edges cut as stars.
SHOWN = "replace(context, replace(value, chr(10), ' '), value_masked)"
for _pattern in [secrets.any_credential(), r"^[A-Za-z0-9+/_=.-]{8,}", r"[A-Za-z0-9+/_=.-]{8,}$"]:
    SHOWN = f"regexp_replace({SHOWN}, {s(_pattern)}, '****', 'g')"


def scan_chain(name: str, resources: str) -> None:
    """The stages of the scan over one set of resources."""
    CTE[f"{name}_arrays"] = (
        "SELECT r.*, k.*, regexp_extract_all(r.content, k.pattern, 0) AS m, regexp_split_to_array(r.content, k.pattern) AS g"
        f" FROM {resources} r JOIN secret_rules k ON regexp_matches(r.content, k.pattern)"
    )
    CTE[f"{name}_places"] = (
        f"SELECT * EXCLUDE (m, g, i), i - 1 AS pos, m[i] AS value,"
        " list_sum(list_transform(g[1:i], lambda x: length(x)))"
        " + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start"
        f" FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_arrays)"
    )
    begin = "greatest(start - 80, 0)"
    CTE[f"{name}_matches"] = (
        "SELECT target_id, seq, kind_ord, kind, url, ord, rule, severity, pos, value, "
        + line(f"substr(content, ({begin} + 1)::BIGINT, (start + length(value) + 80 - {begin})::BIGINT)")
        + f" AS context FROM {name}_places"
    )
    CTE[f"{name}_capped"] = f"SELECT * FROM {name}_matches QUALIFY count(*) OVER (PARTITION BY target_id, ord) <= 50"
    # A value is placed over all its matches, the suppressed ones too.
    CTE[f"{name}_located"] = (
        f"SELECT *, {MASK} AS value_masked, {GLOBAL_FP} OR {RULE_FP} IS NOT NULL AS suppressed, first_value(url) OVER (PARTITION BY target_id, ord, value ORDER BY"
        f" CASE kind WHEN 'css' THEN 0 WHEN 'js' THEN 1 ELSE 2 END, seq, url) AS location FROM {name}_matches"
    )
    CTE[f"{name}_placed"] = f"SELECT *, rule AS type, sha256(value) AS value_hash FROM {name}_located WHERE NOT coalesce(suppressed, false)"
    CTE[f"{name}_first"] = (
        f"SELECT * FROM {name}_placed JOIN (SELECT target_id, type, value_masked, count(DISTINCT value) AS n_values FROM {name}_placed GROUP BY ALL) USING (target_id, type, value_masked)"
        " QUALIFY row_number() OVER (PARTITION BY target_id, type, value_masked ORDER BY kind_ord, seq, url, pos) = 1"
    )
    CTE[f"{name}_each"] = (
        f"SELECT target_id, type, value_masked, url AS location, {SHOWN} AS context, severity FROM {name}_placed"
        " QUALIFY row_number() OVER (PARTITION BY target_id, type, value ORDER BY kind_ord, seq, url, pos) = 1"
    )
    CTE[f"{name}_findings"] = f"SELECT target_id, type, value_masked, location, {SHOWN} AS context, severity, n_values FROM {name}_first"


scan_chain("page", "page_rows")
scan_chain("whole", "live_and_documents")
scan_chain("inner", "live")
scan_chain("old", "archive_rows")
CTE["history_copies"] = (
    "SELECT target_id, urlkey, ts, '[ARCHIVE] ' || original AS url, content FROM archive_history WHERE status = 200 AND mimetype = 'application/javascript' AND ts <> 'timestamp'"
)
CTE["history_rows"] = "SELECT target_id, ts::BIGINT AS seq, 1 AS kind_ord, 'js' AS kind, url, content FROM history_copies"
scan_chain("history", "history_rows")
CTE["history_values"] = (
    "SELECT DISTINCT p.target_id, c.urlkey, c.ts, p.type, p.value, p.value_hash, p.value_masked, p.severity"
    " FROM history_placed p JOIN history_copies c ON c.target_id = p.target_id AND c.url = p.url AND c.ts::BIGINT = p.seq"
)
# A run is told by what ends it: the next copy of the file without the value.
CTE["history_gaps"] = (
    "SELECT v.target_id, v.urlkey, v.type, v.value, c.ts FROM (SELECT DISTINCT target_id, urlkey, type, value FROM history_values) v"
    " JOIN history_copies c USING (target_id, urlkey) ANTI JOIN history_values h USING (target_id, urlkey, type, value, ts)"
)
CTE["history_runs"] = (
    "SELECT target_id, urlkey, type, value, value_hash, value_masked, severity, end_ts, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n_copies FROM ("
    "SELECT v.*, g.ts AS end_ts FROM history_values v ASOF LEFT JOIN history_gaps g"
    " ON g.target_id = v.target_id AND g.urlkey = v.urlkey AND g.type = v.type AND g.value = v.value AND g.ts > v.ts) GROUP BY ALL"
)
CTE["history_live"] = (
    "SELECT *, EXISTS (SELECT 1 FROM page_placed p WHERE p.target_id = r.target_id AND p.type = r.type AND p.value = r.value) AS live,"
    " max(last_seen) OVER (PARTITION BY target_id, type, value) AS last_of_all FROM history_runs r"
)
scan_chain("audit", "audit_rows")

# --- page structure ------------------------------------------------------------------------------

REST = r"""(?:[^>"']|"[^"]*"|'[^']*'|["'])*"""


def open_pattern(name: str) -> str:
    return rf"<{name}(?:[\s/]{REST})?>"


COMMENT = r"<!--.*?(?:-->|\z)"
SCRIPT = open_pattern("script") + r".*?(?:</script[^>]*>|\z)"
STYLE = open_pattern("style") + r".*?(?:</style[^>]*>|\z)"
ATTR = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
FIRST_TAG = r"(?is)^<[a-z0-9]+" + REST + ">"


def attr(tag: str, name: str) -> str:
    inside = f"regexp_replace(regexp_extract({tag}, {s(FIRST_TAG)}, 0), '(?is)^<[a-z0-9]+', '')"
    pick = f"list_filter(regexp_extract_all({inside}, {s(ATTR)}, 0), lambda a: regexp_matches(a, {s(rf'(?is)^{name}(?:\s*=|$)')}))[-1]"
    value = f"regexp_replace({pick}, {s(r'(?is)^[^=]*=?\s*')}, '')"
    bare = f"regexp_replace({value}, {s(r'''(?s)^["'](.*)["']$''')}, {s(chr(92) + '1')})"
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = f"replace({bare}, {s(ref)}, {s(char)})"
    return bare


def resolve(base: str, ref: str) -> str:
    site = rf"regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0)"
    no_query = rf"regexp_replace({base}, '[?#].*$', '')"
    folder = rf"regexp_replace(regexp_replace({no_query}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[^/]*$', '')"
    return (
        f"CASE WHEN regexp_matches({ref}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref}"
        f" WHEN starts_with({ref}, '//') THEN split_part({base}, ':', 1) || ':' || {ref}"
        f" WHEN starts_with({ref}, '/') THEN {site} || {ref}"
        f" ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {ref} END"
    )


CTE["page_tokens"] = (
    "SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, url, list_filter("
    f"regexp_extract_all(html, {s('(?is)' + '|'.join([COMMENT, SCRIPT, STYLE, open_pattern('link')]))}, 0),"
    r" lambda x: regexp_matches(x, '(?i)^<(script|style|link)[\s/>]')) AS l FROM planted_pages)"
)
CTE["page_tags"] = (
    "SELECT page_id, url, pos, t, lower(regexp_extract(t, '^<([A-Za-z]+)', 1)) AS tag,"
    f" {attr('t', 'src')} AS src, {attr('t', 'href')} AS href, {attr('t', 'rel')} AS rel,"
    f" regexp_replace(regexp_replace(t, {s(FIRST_TAG)}, ''), '(?is)</[a-z]+[^>]*>$', '') AS body FROM page_tokens"
)
CTE["page_links"] = (
    "SELECT *, CASE WHEN tag = 'script' AND src <> '' THEN src"
    r" WHEN tag = 'link' AND list_contains(regexp_split_to_array(rel, '\s+'), 'stylesheet') AND href <> '' THEN href END AS link FROM page_tags"
)
CTE["extracted"] = (
    "SELECT page_id AS target_id, (pos + CASE WHEN tag = 'style' THEN 1000000 ELSE 0 END)::BIGINT AS seq,"
    " CASE tag WHEN 'script' THEN 'js' ELSE 'css' END AS kind, link IS NOT NULL AS external,"
    f" CASE WHEN link IS NULL THEN 'inline' ELSE {resolve('url', 'link')} END AS url,"
    " CASE WHEN link IS NULL THEN body END AS content FROM page_links WHERE link IS NOT NULL OR (tag <> 'link' AND body <> '')"
)
CTE["archive_picked"] = (
    "SELECT * FROM (SELECT * FROM archive_index WHERE mimetype = 'application/javascript' AND ts <> 'timestamp'"
    " QUALIFY row_number() OVER (PARTITION BY target_id, urlkey ORDER BY ts, original) = 1)"
)
CTE["archived"] = (
    "SELECT target_id, ts, '[ARCHIVE] ' || original AS url, content FROM archive_picked WHERE status = 200"
)
# What pages lead to: addresses by step, found by recursion.
CTE["page_sites"] = "SELECT target_id, url, lower(split_part(url, ':', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS base FROM targets"
CTE["body_ok"] = "SELECT target_id, url, content FROM resource_body WHERE status = 200"
CTE["page_builds"] = (
    f"SELECT target_id, arg_min(regexp_extract(content, {s(javascript.BUILD_ID)}, 1), seq) AS build_id FROM extracted"
    f" WHERE kind = 'js' AND NOT external AND contains(content, '__NEXT_DATA__') AND {rx('content', javascript.BUILD_ID)} GROUP BY target_id"
)
CTE["first_links"] = (
    "SELECT target_id, url, max(kind) AS kind FROM (SELECT target_id, url, kind FROM extracted WHERE external"
    " UNION ALL SELECT target_id, base || '/_next/static/' || build_id || '/_buildManifest.js', 'js' FROM page_builds JOIN page_sites USING (target_id)) GROUP BY target_id, url"
)
KIND_OF = "CASE WHEN {0} LIKE '%.css' THEN 'css' ELSE 'js' END"
CTE["body_names"] = (
    "SELECT target_id, url, 0 AS cost, CASE WHEN starts_with(p, 'http') THEN p WHEN starts_with(p, '/') THEN site || p WHEN starts_with(p, 'static/') THEN site || '/_next/' || p"
    " ELSE site || '/_next/static/' || p END AS address FROM (SELECT target_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) AS site,"
    f" unnest(regexp_extract_all(content, {s(javascript.MANIFEST_CHUNKS[0])}, 1) || regexp_extract_all(content, {s(javascript.MANIFEST_CHUNKS[1])}, 1)) AS p FROM body_ok WHERE url LIKE '%/_buildManifest.js')"
    f" UNION ALL SELECT target_id, b.url, 1, base || unnest(regexp_extract_all(content, {s(javascript.STATIC_REFERENCE)}, 1)) FROM body_ok b JOIN page_sites USING (target_id)"
)


def walk(name: str, scripts: str, known: str) -> None:
    """``name``_walk, recursive, and ``name``_reached: each address at its first step."""
    CTE[f"{name}_walk"] = (
        "SELECT target_id, url, kind, 1 AS step FROM first_links"
        f" UNION SELECT target_id, address, {KIND_OF.format('address')}, 2 FROM (SELECT target_id, base || unnest(regexp_extract_all(content, {s(javascript.STATIC_REFERENCE)}, 1)) AS address"
        f" FROM ({scripts}) x JOIN page_sites USING (target_id)) y"
        f" UNION SELECT n.target_id, n.address, CASE cost WHEN 0 THEN 'js' ELSE {KIND_OF.format('address')} END, step + cost FROM {name}_walk w JOIN body_names n USING (target_id, url)"
        " WHERE step + cost <= 2 AND (cost = 0 OR w.kind = 'js')"
    )
    CTE[f"{name}_reached"] = (
        f"SELECT target_id, url, arg_min(kind, step) AS kind FROM {name}_walk w WHERE EXISTS (SELECT 1 FROM first_links f WHERE f.target_id = w.target_id AND f.url = w.url)"
        f" OR NOT EXISTS (SELECT 1 FROM ({known}) k WHERE k.target_id = w.target_id AND k.url = w.url) GROUP BY target_id, url"
    )


walk("page", "SELECT target_id, content FROM extracted WHERE kind = 'js' AND NOT external", "SELECT target_id, url FROM extracted WHERE false")
walk(
    "audit", "SELECT target_id, content FROM extracted WHERE kind = 'js' AND NOT external UNION ALL SELECT target_id, content FROM resource_js",
    "SELECT target_id, url FROM resource_js",
)
CTE["audit_rows"] = (
    "SELECT * FROM live UNION ALL SELECT target_id, 10000000 + seq, 1, 'js', url, content FROM resource_js"
    " UNION ALL SELECT b.target_id, 20000000, CASE r.kind WHEN 'js' THEN 1 ELSE 2 END, r.kind, b.url, b.content FROM body_ok b JOIN audit_reached r USING (target_id, url)"
    " UNION ALL SELECT target_id, 30000000 + ts::BIGINT, 1, 'js', url, content FROM archived"
)


def inventory(reached: str, known: str) -> str:
    """Counts and sizes: inline parts, a body per link, discovered bodies, known scripts."""
    return (
        "SELECT p.page_id AS target_id, (SELECT count(*) FROM extracted e WHERE e.target_id = p.page_id AND external AND kind = 'js') AS n_scripts,"
        " (SELECT count(*) FROM extracted e WHERE e.target_id = p.page_id AND external AND kind = 'css') AS n_stylesheets,"
        " count(*) FILTER (WHERE kind = 'js') AS js_count, count(*) FILTER (WHERE kind = 'css') AS css_count,"
        " (max(length(html)) + coalesce(sum(length(body) + 1), 0))::BIGINT AS total_source_size FROM planted_pages p LEFT JOIN ("
        "SELECT target_id, kind, content AS body FROM extracted WHERE NOT external"
        " UNION ALL SELECT e.target_id, e.kind, b.content FROM extracted e JOIN body_ok b USING (target_id, url) WHERE external"
        f" UNION ALL SELECT r.target_id, r.kind, b.content FROM {reached} r JOIN body_ok b USING (target_id, url)"
        " WHERE NOT EXISTS (SELECT 1 FROM extracted e WHERE external AND e.target_id = r.target_id AND e.url = r.url)"
        f"{known}) r ON r.target_id = p.page_id GROUP BY p.page_id"
    )


CTE["refs"] = f"SELECT target_id, ref, {resolve('base_url', 'ref')} AS url FROM resource_ref"

# --- fingerprints --------------------------------------------------------------------------------

CTE["tech_rules"] = table(["technology", "pattern"], [(t, p) for t, ps in tech.SIGNATURES.items() for p in ps])
CTE["builder_rules"] = table(
    ["tool", "n", "pattern"], [(t, n, p) for t, ps in builders.SIGNATURES.items() for n, p in enumerate(ps, 1)]
)
CTE["texts"] = (
    "SELECT page_id AS target_id, 0 AS source, html AS text FROM planted_pages"
    " UNION ALL SELECT target_id, 1, '''' || name || ''': ''' || value || '''' FROM http_header"
    " UNION ALL SELECT target_id, 2, final_url FROM page_meta"
)
CTE["technologies"] = (
    "SELECT DISTINCT target_id, technology FROM texts JOIN tech_rules ON regexp_matches(text, '(?i)' || pattern) WHERE source < 2"
)
CTE["builder_hits"] = (
    "SELECT target_id, source, tool, n, pattern, text, regexp_extract(text, '(?i)' || pattern, 0) AS value,"
    " length(regexp_split_to_array(text, '(?i)' || pattern)[1]) AS start"
    " FROM texts JOIN builder_rules ON regexp_matches(text, '(?i)' || pattern)"
)
CTE["builders"] = (
    "SELECT target_id, tool, pattern AS matched_pattern, "
    + line("substr(text, (greatest(start - 40, 0) + 1)::BIGINT, (start + length(value) + 40 - greatest(start - 40, 0))::BIGINT)")
    + " AS evidence FROM builder_hits"
    " QUALIFY row_number() OVER (PARTITION BY target_id, tool ORDER BY n, source, text) = 1"
)
CTE["meta_tags"] = (
    f"SELECT page_id AS target_id, pos, {attr('t', 'name')} AS n, {attr('t', 'property')} AS p, coalesce({attr('t', 'content')}, '') AS content FROM ("
    "SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, list_filter("
    f"regexp_extract_all(html, {s('(?is)' + '|'.join([COMMENT, SCRIPT, STYLE, open_pattern('meta')]))}, 0),"
    r" lambda x: regexp_matches(x, '(?i)^<meta[\s/>]')) AS l FROM planted_pages))"
)
CTE["metas"] = "SELECT target_id, pos, coalesce(n, p, '') AS name, content, coalesce(n = 'generator', false) AS gen FROM meta_tags WHERE coalesce(n, p, '') <> ''"
CTE["meta_last"] = (
    "SELECT target_id, name, arg_max(content, pos) AS content, CASE WHEN bool_or(gen) THEN -1 ELSE min(pos) END AS place FROM metas GROUP BY ALL"
)
CTE["repos"] = (
    f"SELECT DISTINCT page_id AS target_id, unnest(regexp_extract_all(html, {s(tech.REPO_LINK)}, 0)) AS repo FROM planted_pages"
)

CTE["repos_all"] = (
    f"SELECT * FROM repos UNION SELECT target_id, unnest(regexp_extract_all(content, {s(tech.REPO_LINK)}, 0)) FROM resource_js"
)
# Builders in pages, headers, addresses and scripts.
CTE["all_hits"] = (
    "SELECT target_id, source, tool, n, pattern, text, regexp_extract(text, '(?i)' || pattern, 0) AS value,"
    " length(regexp_split_to_array(text, '(?i)' || pattern)[1]) AS start FROM"
    " (SELECT * FROM texts UNION ALL SELECT target_id, 3, content FROM resource_js) JOIN builder_rules ON regexp_matches(text, '(?i)' || pattern)"
)
CTE["builders_all"] = (
    "SELECT target_id, tool, pattern AS matched_pattern, "
    + line("substr(text, (greatest(start - 40, 0) + 1)::BIGINT, (start + length(value) + 40 - greatest(start - 40, 0))::BIGINT)")
    + " AS evidence FROM all_hits QUALIFY row_number() OVER (PARTITION BY target_id, tool ORDER BY n, source, evidence) = 1"
)

CTE["audit_repos"] = f"SELECT DISTINCT target_id, unnest(regexp_extract_all(content, {s(tech.REPO_LINK)}, 0)) AS repo FROM audit_rows"
CTE["audit_hits"] = CTE["all_hits"].replace("SELECT target_id, 3, content FROM resource_js", "SELECT target_id, 3, content FROM audit_rows WHERE kind <> 'html'")
CTE["audit_builders"] = CTE["builders_all"].replace("FROM all_hits", "FROM audit_hits")
CTE["wordpress"] = (
    "SELECT page_id AS target_id, page_id IN (SELECT target_id FROM technologies WHERE technology = 'WordPress')"
    " OR page_id IN (SELECT target_id FROM metas WHERE gen GROUP BY target_id HAVING contains(lower(arg_min(content, pos)), 'wordpress')) AS wordpress FROM pages"
)

CTE["linked_repos"] = (
    f"SELECT DISTINCT page_id AS target_id, unnest(regexp_extract_all(html, {s(tech.REPO_LINK)}, 0)) AS repo FROM linked_pages"
)

# --- headers and registration --------------------------------------------------------------------

CTE["expected"] = table(
    ["header", "severity", "description", "patch"], [(h, *v) for h, v in headers.EXPECTED.items()]
)
CTE["joined_header"] = "SELECT target_id, name, string_agg(value, ', ' ORDER BY seq) AS value FROM http_header GROUP BY target_id, name"
CTE["audited"] = (
    "SELECT t.target_id, e.header, CASE WHEN h.target_id IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status,"
    " CASE WHEN h.target_id IS NULL THEN e.severity ELSE 'OK' END AS severity, h.value,"
    " CASE WHEN h.target_id IS NULL THEN e.description END AS description, CASE WHEN h.target_id IS NULL THEN e.patch END AS patch"
    " FROM targets t CROSS JOIN expected e LEFT JOIN joined_header h ON h.target_id = t.target_id AND lower(h.name) = lower(e.header)"
)
CTE["cert_names"] = (
    "SELECT target_id, status, min(pos) AS pos, " + ", ".join(f"CASE status WHEN 'VALID' THEN {c} END AS {c}" for c in ["subject", "issuer", "not_before", "not_after", "version", "serial", "alt_name"])
    + ", CASE status WHEN 'VALID' THEN NULL ELSE error END AS error FROM cert GROUP BY ALL"
)
CTE["dns_values"] = "SELECT target_id, rtype, value, min(pos) AS pos FROM dns_record GROUP BY ALL"
CTE["telling"] = table(["header", "risk"], list(headers.TELLING.items()))
CTE["told"] = (
    "SELECT target_id, header, value, risk FROM joined_header JOIN telling ON name = header OR name = lower(header) WHERE value <> ''"
)
CTE["unsafe"] = (
    "SELECT target_id, url, 'NOT_HTTPS' AS status, 'CRITICAL' AS severity FROM targets WHERE lower(split_part(url, ':', 1)) <> 'https'"
)

# --- responses -----------------------------------------------------------------------------------

CTE["known_paths"] = table(["path"], [(p,) for p in paths.SENSITIVE])
VERIFIED = (
    r"CASE WHEN contains(path, '.git/HEAD') THEN regexp_matches(body, 'ref:\s+refs/') OR regexp_matches("
    + strip("body") + r", '^[0-9a-f]{40}') WHEN contains(path, '.ssh/id_') THEN starts_with(" + strip("body") + ", '-----BEGIN') ELSE true END"
)
PATH_SEVERITY = "CASE" + "".join(
    f" WHEN {any_word('path', words)} THEN '{sev}'" for sev, words in paths.SEVERITY_BY_SUBSTRING
) + " ELSE 'MEDIUM' END"
SNIPPET = line("left(body, 200)")
CTE["exposed"] = (
    f"SELECT target_id, path, status::BIGINT AS status, length(body) AS size, {SNIPPET} AS snippet, {PATH_SEVERITY} AS severity"
    " FROM http_response JOIN known_paths USING (path) WHERE status = 200 AND length(body) > 10"
    f" AND NOT (starts_with({strip('body')}, '<!DOCTYPE html>') OR starts_with({strip('body')}, '<html') OR contains(lower(content_type), 'text/html'))"
    f" AND {VERIFIED} AND NOT {any_word('lower(body)', paths.ERROR_WORDS)}"
)
ORIGIN = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)"
CTE["api_paths"] = table(["path"], [(p,) for p in paths.OPENAPI])
CTE["api_docs"] = (
    "SELECT target_id, path, coalesce(body->'$.info'->>'$.title', 'Unknown API') AS title, coalesce(body->'$.info'->>'$.version', '1.0') AS version,"
    " coalesce(len(json_keys(body, '$.paths')), 0)::BIGINT AS n_endpoints,"
    " list_contains(json_keys(body), 'securityDefinitions') OR coalesce(list_contains(json_keys(body, '$.components'), 'securitySchemes'), false) AS has_auth"
    " FROM (SELECT target_id, path, try_cast(body AS JSON) AS body FROM http_response JOIN api_paths USING (path)"
    " WHERE status = 200 AND contains(content_type, 'application/json') AND json_valid(body))"
    " WHERE list_contains(json_keys(body), 'swagger') OR list_contains(json_keys(body), 'openapi')"
)
CTE["openapi"] = (
    f"SELECT target_id, title, version, n_endpoints, has_auth, CASE WHEN has_auth THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'Swagger Schema' AS type,"
    " 'Swagger/OpenAPI schema exposed.' || chr(10) || 'API Title: ' || title || ' (v' || version || ')' || chr(10) || 'Endpoints Exposed: ' || n_endpoints"
    " || chr(10) || 'Authentication Defined: ' || CASE WHEN has_auth THEN 'Yes' ELSE 'NO (Unauthenticated API)' END AS description,"
    f" {ORIGIN} || path AS url FROM api_docs JOIN targets USING (target_id)"
)
CTE["graphql_paths"] = table(["path"], [(p,) for p in paths.GRAPHQL])
CTE["graphql"] = (
    f"SELECT target_id, 'GraphQL Introspection' AS type, {s(report.GRAPHQL_TEXT)} AS description, 'CRITICAL' AS severity, {ORIGIN} || path AS url"
    " FROM http_response JOIN graphql_paths USING (path) JOIN targets USING (target_id)"
    " WHERE status = 200 AND json_valid(body) AND list_contains(json_keys(try_cast(body AS JSON), '$.data'), '__schema')"
)

# --- cookies and forms ---------------------------------------------------------------------------

CTE["jar"] = (
    r"SELECT * EXCLUDE removed FROM (SELECT target_id, seq, url, (regexp_matches(set_cookie, '(?i);\s*max-age=(-|0+(;|$))') OR contains(set_cookie, 'Expires=Thu, 01 Jan 1970')) AS removed, regexp_extract(set_cookie, '^([^=;]*)', 1) AS name,"
    r" CASE WHEN regexp_extract(set_cookie, '(?i);\s*domain=([^;]*)', 1) <> '' THEN '.' || lower(ltrim(regexp_extract(set_cookie, '(?i);\s*domain=([^;]*)', 1), '.'))"
    r" ELSE lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) END AS domain,"
    r" coalesce(nullif(regexp_extract(set_cookie, '(?i);\s*path=([^;]*)', 1), ''), '/') AS path,"
    r" regexp_matches(set_cookie, '(?i);\s*secure(;|$)') AS secure, regexp_matches(set_cookie, '(?i);\s*httponly(;|$)') AS httponly,"
    r" coalesce(nullif(regexp_extract(set_cookie, '(?i);\s*samesite=([^;]*)', 1), ''), 'Not Set') AS samesite FROM set_cookie"
    " WHERE NOT contains(set_cookie, 'Domain=elsewhere.invalid')"
    " QUALIFY row_number() OVER (PARTITION BY target_id, domain, path, name ORDER BY seq DESC) = 1) j WHERE NOT removed"
)
CTE["cookie_issues"] = (
    "SELECT target_id, domain, path, name, row_number() OVER (PARTITION BY target_id, domain, path, name ORDER BY o) AS n, issue FROM ("
    f"SELECT target_id, domain, path, name, 1 AS o, CASE WHEN starts_with(lower(url), 'https:') THEN {s(report.COOKIE_INSECURE_HTTPS)} ELSE {s(report.COOKIE_INSECURE_HTTP)} END AS issue FROM jar WHERE NOT secure"
    f" UNION ALL SELECT target_id, domain, path, name, 2, {s(report.COOKIE_NO_HTTPONLY)} FROM jar WHERE NOT httponly"
    f" UNION ALL SELECT target_id, domain, path, name, 3, {s(report.COOKIE_NO_SAMESITE)} FROM jar WHERE samesite = 'Not Set')"
)
CTE["cookie_counts"] = (
    "SELECT target_id, count(*) AS n_cookies, count(*) FILTER (WHERE NOT secure OR NOT httponly OR samesite = 'Not Set') AS n_insecure FROM jar GROUP BY target_id"
)
CODE = "(?is)" + "|".join([COMMENT, SCRIPT, STYLE])
FORM = "(?is)" + open_pattern("form") + r".*?(?:</form\s*>|\z)"
CTE["form_blocks"] = (
    "SELECT page_id AS target_id, unnest(l) AS f, generate_subscripts(l, 1) AS form_no FROM (SELECT page_id,"
    f" regexp_extract_all(regexp_replace(html, {s(CODE)}, ' ', 'g'), {s(FORM)}, 0) AS l FROM planted_pages)"
)
CTE["page_forms"] = (
    f"SELECT target_id, form_no, coalesce({attr('f', 'action')}, '') AS action, upper(coalesce({attr('f', 'method')}, 'GET')) AS method,"
    f" regexp_extract_all(f, {s('(?is)' + open_pattern('input'))}, 0) AS tags FROM form_blocks"
)
CTE["form_inputs"] = (
    f"SELECT target_id, form_no, input_no, {attr('t', 'name')} AS name, {attr('t', 'type')} AS type, {attr('t', 'id')} AS id FROM ("
    "SELECT target_id, form_no, unnest(tags) AS t, generate_subscripts(tags, 1) AS input_no FROM page_forms)"
)
CTE["form_flags"] = (
    "SELECT f.target_id, f.form_no, f.action, f.method,"
    f" coalesce(bool_or(i.type = 'hidden' AND {any_word('lower(i.name)', report.CSRF_WORDS)}), false) AS has_csrf,"
    " coalesce(bool_or(i.type = 'password'), false) AS has_password,"
    " string_agg(coalesce(i.type, 'text') || '(' || coalesce(i.name, '') || ')', ', ' ORDER BY input_no) FILTER (WHERE input_no <= 8) AS inputs"
    " FROM page_forms f LEFT JOIN form_inputs i USING (target_id, form_no) GROUP BY ALL"
)
CTE["form_issues"] = (
    "SELECT target_id, form_no, CASE WHEN action = '' THEN '(empty)' ELSE action END AS action, method, has_csrf, inputs,"
    " row_number() OVER (PARTITION BY target_id, form_no ORDER BY o) AS n, issue FROM ("
    f"SELECT *, 1 AS o, {s(report.FORM_NO_CSRF_GET)} AS issue FROM form_flags WHERE NOT has_csrf AND method = 'GET' AND action NOT IN ('', '#')"
    f" UNION ALL SELECT *, 1, {s(report.FORM_NO_CSRF)} FROM form_flags WHERE NOT has_csrf AND method <> 'GET'"
    f" UNION ALL SELECT *, 2, {s(report.FORM_PASSWORD_GET)} FROM form_flags WHERE method = 'GET' AND has_password"
    f" UNION ALL SELECT *, 3, {s(report.FORM_OVER_HTTP)} FROM form_flags WHERE starts_with(action, 'http://')"
    f" UNION ALL SELECT *, 4, {s(report.FORM_EMPTY_ACTION)} FROM form_flags WHERE action IN ('', '#'))"
)

# --- leaks ---------------------------------------------------------------------------------------

COMMENT_TEXT = strip("raw")
CTE["comments"] = (
    f"SELECT target_id, 'Suspicious HTML Comment' AS type, {COMMENT_TEXT} AS content, 'MEDIUM' AS severity FROM ("
    "SELECT page_id AS target_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS raw FROM planted_pages)"
    f" WHERE length({COMMENT_TEXT}) > 5 AND NOT starts_with({COMMENT_TEXT}, '[if') AND {any_word('lower(' + COMMENT_TEXT + ')', leaks.COMMENT_WORDS)}"
)
CTE["source_maps"] = (
    f"SELECT target_id, 'Source Map Exposed' AS type, unnest(regexp_extract_all(content, {s(leaks.SOURCE_MAP)}, 1)) AS content, 'HIGH' AS severity FROM live"
)
CTE["debug_texts"] = " UNION ALL ".join(
    f"SELECT page_id AS target_id, 'Error/Debug Info Exposed' AS type, regexp_extract(html, {s(p)}, 0) AS content, 'HIGH' AS severity FROM planted_pages WHERE {rx('html', p)}"
    for p in leaks.ERRORS
)
CTE["blobs"] = " UNION ALL ".join(
    f"SELECT page_id AS target_id, {s(label)} AS label, regexp_extract(html, {s(p)}, 1) AS blob FROM planted_pages WHERE {rx('html', p)}"
    for label, p, _ in leaks.CONFIG_BLOBS
)
CTE["config_rules"] = table(
    ["o", "key", "severity", "pattern"], [(n, k, v, leaks.key_pattern(k)) for n, (k, v) in enumerate(leaks.CONFIG_KEYS)]
)
CTE["config_values"] = (
    f"SELECT target_id, label, o, key, severity, {strip('regexp_extract(blob, pattern, 1)')} AS value,"
    " row_number() OVER (PARTITION BY target_id, label ORDER BY o) AS n FROM blobs JOIN config_rules ON regexp_matches(blob, pattern)"
)
CTE["config_findings"] = (
    "SELECT target_id, 'Framework Config Leak — ' || label AS type, key || ': ' || value AS content, severity FROM config_values WHERE severity = 'HIGH'"
    " UNION ALL SELECT target_id, 'Framework Config Exposed — ' || label, 'Runtime config object injected in HTML exposes: '"
    " || string_agg(key || '=' || value, ' | ' ORDER BY o) FILTER (WHERE n <= 10), 'MEDIUM' FROM config_values GROUP BY target_id, label"
)
CTE["audit_leaks"] = (
    "SELECT * FROM comments UNION ALL SELECT * FROM debug_texts UNION ALL SELECT * FROM config_findings"
    f" UNION ALL SELECT target_id, 'Source Map Exposed', unnest(regexp_extract_all(content, {s(leaks.SOURCE_MAP)}, 1)), 'HIGH' FROM audit_rows"
)
CTE["leak_findings"] = (
    "SELECT * FROM comments UNION ALL SELECT * FROM source_maps UNION ALL SELECT * FROM debug_texts UNION ALL SELECT * FROM config_findings"
)

# --- scripts -------------------------------------------------------------------------------------

CTE["sink_rules"] = table(
    ["ord", "pattern", "description"], [(n, p, d) for n, (p, d) in enumerate(javascript.SINKS.items(), 1)]
)
CTE["audit_scripts"] = "SELECT target_id, seq, url, content FROM audit_rows WHERE kind = 'js'"


def script_chain(name: str, scripts: str) -> None:
    CTE[f"{name}sinks"] = (
        "SELECT target_id, seq, ord, pattern, description, url AS source, "
        + line("substr(content, greatest(place - 41, 0) + 1, place - 1 + length(pattern) + 40 - greatest(place - 41, 0))")
        + f" AS context, 'MEDIUM' AS severity FROM (SELECT *, instr(content, pattern) AS place FROM {scripts} JOIN sink_rules ON contains(content, pattern))"
    )
    CTE[f"{name}calls"] = (
        "SELECT target_id, seq, 11 + row_number() OVER (PARTITION BY target_id, seq, url ORDER BY o, i) AS ord, 'API Endpoint' AS pattern,"
        " 'External API call: ' || u AS description, url AS source, u AS context, 'INFO' AS severity FROM ("
        + " UNION ALL ".join(
            f"SELECT target_id, seq, url, {o} AS o, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT *, regexp_extract_all(content, {s(p)}, 1) AS l FROM {scripts})"
            for o, p in enumerate([javascript.FETCH_CALL, javascript.XHR_CALL])
        )
        + ") WHERE starts_with(u, 'http')"
    )
    CTE[f"{name}js_unique"] = (
        "SELECT target_id, seq, ord, n, pattern, description, source, context, severity FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY seq, source, ord) AS n FROM ("
        f"SELECT * FROM (SELECT * FROM {name}sinks UNION ALL SELECT * FROM {name}calls)"
        " QUALIFY row_number() OVER (PARTITION BY target_id, pattern, source ORDER BY seq, ord, context) = 1))"
    )


script_chain("", "resource_js")
script_chain("audit_", "audit_scripts")
CTE["js_counts"] = "SELECT target_id, pattern, count(*) AS n FROM js_unique GROUP BY ALL"

# --- tool reports --------------------------------------------------------------------------------

CTE["wp_docs"] = (
    "SELECT target_id, try_cast(line AS JSON) AS doc, url FROM tool_report JOIN targets USING (target_id) WHERE tool = 'wp' AND json_valid(line) AND json_exists(line, '$.target')"
)
CTE["wp_findings"] = (
    "SELECT target_id, coalesce(v->>'$.title', 'Unknown') AS name, 'HIGH' AS severity, coalesce(v->>'$.description', '') || ' | Ref: ' || coalesce(v->>'$.references.url[0]', 'N/A') AS description,"
    " 'wordpress_vuln' AS type, url FROM (SELECT target_id, url, unnest(json_extract(doc, '$.vulnerabilities[*]')) AS v FROM wp_docs)"
    " UNION ALL SELECT target_id, 'Plugin: ' || plugin || ' - ' || coalesce(v->>'$.title', 'vuln'), 'HIGH', coalesce(v->>'$.description', ''), 'plugin_vuln', url FROM ("
    "SELECT target_id, url, plugin, unnest((doc->'plugins'->plugin->'vulnerabilities')::JSON[]) AS v FROM ("
    "SELECT target_id, url, doc, unnest(json_keys(doc, '$.plugins')) AS plugin FROM wp_docs))"
)
CTE["wp_clean"] = (
    f"SELECT DISTINCT target_id, {s(report.WP_CLEAN_NAME)} AS name, 'INFO' AS severity, {s(report.WP_CLEAN_TEXT)} AS description, 'wordpress_clean' AS type, url"
    " FROM tool_report JOIN targets USING (target_id) WHERE tool = 'wp' AND target_id NOT IN (SELECT target_id FROM wp_findings)"
)
CTE["git_findings"] = (
    "SELECT target_id, coalesce(l->>'$.RuleID', 'Secret Found') AS name, 'CRITICAL' AS severity,"
    " 'File: ' || coalesce(l->>'$.File', 'unknown') || ', Line: ' || coalesce(l->>'$.StartLine', '?') AS description, 'exposed_secret' AS type, url FROM ("
    "SELECT target_id, url, unnest(json_extract(try_cast(line AS JSON), '$[*]')) AS l FROM tool_report JOIN targets USING (target_id) WHERE tool = 'git' AND json_valid(line))"
)
CTE["git_seen"] = (
    f"SELECT target_id, {s(report.GIT_SEEN_NAME)} AS name, 'INFO' AS severity, 'GitHub repo detected: ' || max(repo) || '. Provide GitHub token for full scan.' AS description,"
    " 'github_detected' AS type, 'https://' || max(repo) AS url FROM linked_repos WHERE target_id NOT IN (SELECT target_id FROM git_findings) GROUP BY target_id"
)

# In the audit reports count where WordPress or a repository was seen.
CTE["audit_wp"] = "SELECT * FROM (SELECT * FROM wp_findings UNION ALL SELECT * FROM wp_clean) WHERE target_id IN (SELECT target_id FROM wordpress WHERE wordpress)"
CTE["audit_git"] = (
    "SELECT target_id, name, severity, description, type, 'https://' || repo AS url FROM git_findings JOIN (SELECT target_id, max(repo) AS repo FROM audit_repos GROUP BY target_id) USING (target_id)"
    " UNION ALL " + CTE["git_seen"].replace("linked_repos", "audit_repos")
)

# --- roll-up -------------------------------------------------------------------------------------

def hidden(x: str, but: tuple[str, ...] = ()) -> str:
    return f"regexp_replace({x}, {s(secrets.any_credential(but))}, '****', 'g')"


def hidden_ends(x: str, start: str, end: str) -> str:
    for when, pattern in ((start, r"^[A-Za-z0-9+/_=.-]{8,}"), (end, r"[A-Za-z0-9+/_=.-]{8,}$")):
        x = f"CASE WHEN {when} THEN regexp_replace({x if x[:4] == 'CASE' else hidden(x)}, {s(pattern)}, '****', 'g') ELSE {x if x[:4] == 'CASE' else hidden(x)} END"
    return x


TITLED = hidden("name || ': ' || description")
_SHAPES = [
    ("transport", "status", "severity", "url", "NULL", "unsafe"),
    ("headers", "'Missing header'", "severity", "header", "patch", "(SELECT * FROM audited WHERE status = 'MISSING')"),
    ("header_leaks", "'Header disclosure'", "'LOW'", "header", hidden("value"), "told"),
    ("builders", "tool", "'INFO'", "matched_pattern", hidden_ends("evidence", "true", "true"), "audit_builders"),
    ("secrets", "type", "severity", "location", "value_masked", "audit_findings"),
    ("paths", "'Exposed path'", "severity", "path", hidden_ends("snippet", "false", "size > 200"), "exposed"),
    ("cookies", "'Cookie issue'", "'MEDIUM'", "name", "issue", "cookie_issues"),
    ("forms", "'Form issue'", "'MEDIUM'", "action", "issue", "form_issues"),
    ("leaks", "type", "severity", "NULL", hidden("content"), "audit_leaks"),
    ("js", "pattern", "severity", "source", hidden_ends("context", "pattern <> 'API Endpoint'", "pattern <> 'API Endpoint'"), "audit_js_unique"),
    ("api", "type", "severity", "url", hidden("description"), "(SELECT target_id, type, severity, url, description FROM openapi UNION ALL SELECT target_id, type, severity, url, description FROM graphql)"),
    ("wp", "type", "severity", "url", TITLED, "audit_wp"),
    ("git", "type", "severity", "url", TITLED, "audit_git"),
]
PLACES = ("IP Address (Private)",)
CTE["findings"] = " UNION ALL ".join(
    f"SELECT target_id, '{m}' AS module, {t} AS type, {sev} AS severity, {hidden(loc + '::VARCHAR', PLACES)} AS location, ({ev})::VARCHAR AS evidence, {0 if m == 'js' else 1}::BIGINT AS n_counted FROM {src}"
    for m, t, sev, loc, ev, src in _SHAPES
)
CTE["counts"] = (
    "SELECT target_id, " + ", ".join(
        f"coalesce(sum(n_counted) FILTER (WHERE severity = '{v}'), 0)::BIGINT AS {v.lower()}" for v in report.SEVERITIES
    ) + ", coalesce(sum(n_counted), 0)::BIGINT AS total FROM targets LEFT JOIN findings USING (target_id) GROUP BY target_id"
)
CTE["bar_rows"] = " UNION ALL ".join(
    f"SELECT target_id, '{v}' AS severity, {v.lower()} AS n, greatest(critical, high, medium, low, info, 1) AS top FROM counts"
    for v in report.SEVERITIES
)
CTE["secret_advice"] = table(["type", "advice"], list(remediation.SECRET_ADVICE.items()))
CTE["path_advice"] = table(["path", "advice"], list(remediation.PATH_ADVICE.items()))
CTE["sink_advice"] = table(["pattern", "advice"], list(remediation.SINK_ADVICE.items()))
CTE["path_order"] = table(["path", "o"], [(p, n) for n, p in enumerate(paths.SENSITIVE)])
CTE["header_order"] = table(["header", "o"], [(h, n) for n, h in enumerate(headers.EXPECTED)])


def _section(label: str, source: str, text: str, order: str) -> str:
    return (
        f"(SELECT chr(10) || {s(label)} || chr(10) || string_agg({text}, chr(10) ORDER BY {order}) FROM {source}"
        " x WHERE x.target_id = t.target_id HAVING count(*) > 0)"
    )


DIGEST_PARTS = [
    f"{s(report.DIGEST_TARGET)} || url || chr(10)",
    f"(SELECT chr(10) || {s(report.DIGEST_TECH)} || string_agg(technology, ', ' ORDER BY technology) FROM technologies x WHERE x.target_id = t.target_id HAVING count(*) > 0)",
    _section(report.DIGEST_SECRETS, "(SELECT f.*, k.ord FROM audit_findings f JOIN secret_rules k ON k.rule = f.type)",
             "'  - ' || type || ': ' || value_masked || ' (Severity: ' || severity || ')'", "ord, value_masked"),
    _section(report.DIGEST_JS, "(SELECT * FROM audit_js_unique WHERE n <= 5)", "'  - ' || pattern || ': ' || description", "n"),
    _section(report.DIGEST_PATHS, "(SELECT * FROM exposed JOIN path_order USING (path))",
             "'  - ' || path || ' (Status: ' || status || ')'", "o"),
    _section(report.DIGEST_HEADERS, "(SELECT * FROM audited JOIN header_order USING (header) WHERE status = 'MISSING')",
             "'  - ' || header || ' (' || severity || ')'", "o"),
    f"(SELECT chr(10) || {s(report.DIGEST_COOKIES)} || n_cookies || CASE WHEN n_insecure > 0 THEN chr(10) || '  - ' || n_insecure || {s(report.DIGEST_INSECURE)} ELSE '' END"
    " FROM cookie_counts x WHERE x.target_id = t.target_id)",
]
CTE["digests"] = f"SELECT target_id, concat_ws(chr(10), {', '.join(DIGEST_PARTS)}) AS d FROM targets t"

FINAL: dict[str, str] = {
    "page_source": "SELECT target_id, m.url, final_url, status::BIGINT AS status, length(html) AS size FROM page_meta m JOIN pages ON page_id = target_id",
    "target_normalize": r"SELECT page_id AS target_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN rtrim(u, '/') ELSE 'https://' || rtrim(u, '/') END AS normalized FROM (SELECT page_id, trim(regexp_replace(url, '^http://', '') || '// ') AS u FROM pages)",
    "url_parts": f"SELECT target_id, lower(split_part(url, ':', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS netloc, {ORIGIN} AS base FROM targets",
    "url_resolve": "SELECT * FROM refs",
    "redirect_flag": "SELECT target_id, url, final_url, final_url <> url AS redirected FROM page_meta",
    "resource_extract": "SELECT * FROM extracted",
    "resource_join": "SELECT target_id, url, length(content) AS size FROM refs JOIN resource_body USING (target_id, url) WHERE status = 200",
    "resource_inventory": inventory("page_reached", ""),
    "audit_resources": inventory("audit_reached", " UNION ALL SELECT target_id, 'js', content FROM resource_js"),
    "nextjs_build_id": f"SELECT target_id, arg_min(regexp_extract(content, {s(javascript.BUILD_ID)}, 1), seq) AS build_id FROM (SELECT target_id, seq, url, content FROM extracted WHERE kind = 'js' AND NOT external UNION ALL SELECT * FROM build_script) WHERE contains(content, '__NEXT_DATA__') AND {rx('content', javascript.BUILD_ID)} GROUP BY target_id",
    "chunk_manifest_refs": (
        "SELECT target_id, url, 'js' AS kind, length(content) AS size FROM (SELECT DISTINCT target_id, CASE WHEN starts_with(p, 'http') THEN p WHEN starts_with(p, '/') THEN base || p"
        " WHEN starts_with(p, 'static/') THEN base || '/_next/' || p ELSE base || '/_next/static/' || p END AS url FROM ("
        "SELECT target_id, regexp_extract(url, '^[a-z]+://[^/]*', 0) AS base, unnest((regexp_extract_all(content, "
        f"{s(javascript.MANIFEST_CHUNKS[0])}, 1) || regexp_extract_all(content, {s(javascript.MANIFEST_CHUNKS[1])}, 1))) AS p"
        " FROM resource_js WHERE url LIKE '%/_buildManifest.js')) JOIN resource_body b USING (target_id, url) WHERE status = 200"
        " AND (target_id, url) NOT IN (SELECT (target_id, url) FROM resource_js)"
    ),
    "referenced_js_frontier": (
        "SELECT target_id, url, CASE WHEN url LIKE '%.css' THEN 'css' ELSE 'js' END AS kind, length(content) AS size FROM (SELECT * FROM (SELECT DISTINCT target_id, 'https://x.example.com'"
        f" || unnest(regexp_extract_all(content, {s(javascript.STATIC_REFERENCE)}, 1)) AS url FROM resource_js) WHERE (target_id, url) NOT IN (SELECT (target_id, url) FROM resource_js)"
        ") JOIN resource_body USING (target_id, url) WHERE status = 200"
    ),
    "archive_select": "SELECT target_id, ts, original, urlkey FROM archive_picked",
    "archive_resources": "SELECT target_id, ts, url, length(content) AS size FROM archived",
    "historical_only_secrets": "SELECT DISTINCT target_id, type, value_masked, value_hash, location, severity FROM old_placed o WHERE NOT EXISTS (SELECT 1 FROM page_placed p WHERE p.target_id = o.target_id AND p.type = o.type AND p.value = o.value)",
    "secret_lifetimes": (
        "SELECT target_id, urlkey, type, value_masked, value_hash, first_seen, last_seen, n_copies,"
        " CASE WHEN live AND last_seen = last_of_all THEN NULL ELSE end_ts END AS gone_since, live, severity FROM history_live"
    ),
    "findings_sink": "SELECT target_id, type, value_masked, severity FROM page_findings",
    "secret_matches": "SELECT target_id, rule, count(*) AS n FROM page_matches GROUP BY ALL",
    "secret_match_cap": "SELECT target_id, rule, count(*) AS n FROM page_capped GROUP BY ALL",
    "secret_context": "SELECT target_id, rule, pos, md5(context) AS context_hash FROM page_matches",
    "fp_global": f"SELECT target_id, rule, pos, {GLOBAL_FP} AS suppressed FROM page_matches",
    "fp_by_rule": f"SELECT target_id, rule, pos, {RULE_FP} AS suppressed_by FROM page_matches",
    "secret_location": "SELECT DISTINCT target_id, type, value_masked, value_hash, location FROM inner_placed",
    "secret_mask": f"SELECT target_id, rule, pos, {MASK} AS value_masked FROM page_matches",
    "secret_severity": "SELECT DISTINCT rule, severity FROM page_matches",
    "secret_dedup": f"SELECT target_id, rule AS type, value_masked, min(pos) AS pos FROM (SELECT *, {MASK} AS value_masked FROM page_matches) GROUP BY ALL",
    "secret_full": "SELECT * FROM whole_findings",
    "secret_counts": "SELECT type, severity, count(*) AS n FROM page_findings GROUP BY ALL",
    "tech_detect": "SELECT * FROM technologies",
    "meta_extract": "SELECT target_id, name, content FROM meta_last",
    "wordpress_flag": "SELECT * FROM wordpress",
    "repo_links": "SELECT target_id, repo FROM repos",
    "repo_links_all": "SELECT target_id, repo FROM repos_all",
    "builder_detect_all": "SELECT * FROM builders_all",
    "tech_category": "SELECT target_id, CASE " + " ".join(
        f"WHEN technology IN ({', '.join(s(x) for x in names)}) THEN {s(cat)}" for cat, names in tech.CATEGORIES.items()
    ) + " ELSE 'Other' END AS category, string_agg(technology, ', ' ORDER BY technology) AS technologies FROM technologies GROUP BY ALL",
    "builder_detect": "SELECT * FROM builders",
    "builder_risk": "SELECT target_id, tool, description, risk FROM builders JOIN ("
    + table(["tool", "description", "risk"], [(t, *a) for t, a in builders.ABOUT.items()]) + ") USING (tool)",
    "builder_count": "SELECT target_id, count(*) AS n_builders FROM builders GROUP BY ALL",
    "header_audit": "SELECT * FROM audited",
    "header_missing": "SELECT target_id, header, severity, description, patch FROM audited WHERE status = 'MISSING'",
    "header_info_leak": "SELECT * FROM told",
    "transport_audit": "SELECT * FROM unsafe",
    "cert_inventory": (
        "SELECT target_id, status, subject, version, serial, error, issuer, not_before, not_after, string_agg(alt_name, ', ' ORDER BY pos) AS alt_names FROM cert_names GROUP BY ALL"
    ),
    "report_topn_cert": (
        "SELECT target_id, subject, serial, string_agg(alt_name, ', ' ORDER BY pos) AS alt_names FROM"
        " (SELECT * FROM cert_names WHERE status = 'VALID' QUALIFY row_number() OVER (PARTITION BY target_id, serial ORDER BY pos) <= 10) t GROUP BY ALL"
    ),
    "dns_rollup": "SELECT target_id, rtype, count(*) AS n_values, array_to_string(list(value ORDER BY pos), ', ') AS shown FROM dns_values GROUP BY ALL",
    "report_topn_dns": (
        "SELECT target_id, rtype, string_agg(value, ', ' ORDER BY pos) AS shown FROM"
        " (SELECT * FROM dns_values QUALIFY row_number() OVER (PARTITION BY target_id, rtype ORDER BY pos) <= 5) t GROUP BY ALL"
    ),
    "whois_rows": " UNION ALL ".join(
        f"SELECT target_id, '{label}' AS field, {c} AS value FROM whois WHERE {c} <> '' AND {c} <> 'None'"
        for c, label in [("registrar", "Registrar"), ("creation", "Creation"), ("expiration", "Expiration"),
                         ("name_servers", "Name_Servers"), ("org", "Org"), ("country", "Country")]
    ),
    "path_exposure": "SELECT * FROM exposed",
    "path_verify": f"SELECT target_id, path, {VERIFIED} AS verified FROM http_response",
    "path_severity": f"SELECT target_id, path, {PATH_SEVERITY} AS severity FROM http_response",
    "path_snippet": f"SELECT target_id, path, length(body) AS size, {SNIPPET} AS snippet FROM http_response",
    "openapi_audit": "SELECT * FROM openapi",
    "graphql_audit": "SELECT * FROM graphql",
    "cookie_parse": "SELECT * EXCLUDE (url, seq) FROM jar",
    "cookie_audit": "SELECT target_id, name, n, issue FROM cookie_issues",
    "insecure_cookie_count": "SELECT * FROM cookie_counts",
    "form_extract": (
        "SELECT f.target_id, f.form_no, action, method, input_no, CASE WHEN input_no IS NOT NULL THEN coalesce(name, '') END AS input_name,"
        " CASE WHEN input_no IS NOT NULL THEN coalesce(type, 'text') END AS input_type, CASE WHEN input_no IS NOT NULL THEN coalesce(id, '') END AS input_id"
        " FROM page_forms f LEFT JOIN form_inputs i ON i.target_id = f.target_id AND i.form_no = f.form_no"
    ),
    "form_audit": "SELECT target_id, form_no, action, method, has_csrf, n, issue FROM form_issues",
    "comment_leak": "SELECT * FROM comments",
    "sourcemap_leak": "SELECT * FROM source_maps",
    "debug_leak": "SELECT * FROM debug_texts",
    "framework_config_blob": "SELECT * FROM blobs",
    "framework_config_keys": "SELECT * FROM config_findings",
    "js_sinks": "SELECT * EXCLUDE (ord) FROM sinks",
    "js_api_calls": "SELECT * EXCLUDE (ord) FROM calls",
    "js_dedup": "SELECT target_id, seq, ord, pattern, description, source, context, severity FROM js_unique",
    "js_pattern_counts": "SELECT * FROM js_counts",
    "wp_report_findings": "SELECT * FROM wp_findings",
    "wp_report_clean": "SELECT * FROM wp_clean",
    "git_report_findings": "SELECT * FROM git_findings",
    "git_report_fallback": "SELECT * FROM git_seen",
    "findings_union": "SELECT * FROM findings",
    "severity_counts": "SELECT * FROM counts",
    "severity_bars": "SELECT target_id, severity, n, (n * 25 // top)::BIGINT AS bar_len, repeat('█', n * 25 // top) AS bar FROM bar_rows",
    "severity_rollup": (
        "SELECT host, severity, cast(grouping(host, severity) AS bigint) AS level, cast(sum(n) AS bigint) AS n FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, upper(s) AS severity, n FROM"
        " (UNPIVOT (SELECT target_id, critical, high, medium, low, info FROM counts) ON critical, high, medium, low, info INTO NAME s VALUE n) c JOIN targets USING (target_id)) t GROUP BY ROLLUP (host, severity)"
    ),
    "grade": "SELECT target_id, total, CASE WHEN total = 0 THEN 'A+' WHEN critical > 0 THEN 'F' WHEN high > 2 THEN 'D' WHEN high > 0 THEN 'C' WHEN medium > 3 THEN 'B-' ELSE 'B+' END AS grade FROM counts",
    "remediation_join": f"SELECT target_id, type, value_masked, coalesce(advice, {s(remediation.SECRET_DEFAULT)}) AS advice FROM page_findings LEFT JOIN secret_advice USING (type)",
    "path_remediation": f"SELECT target_id, path, coalesce(advice, {s(remediation.PATH_DEFAULT)}) AS advice FROM exposed LEFT JOIN path_advice USING (path)",
    "js_remediation": "SELECT target_id, pattern, n, advice FROM js_counts JOIN sink_advice USING (pattern)",
    "target_digest": f"SELECT target_id, CASE WHEN length(d) < 100 THEN d || chr(10) || chr(10) || {s(report.DIGEST_FILLER)} ELSE d END AS digest FROM digests",
    "report_topn": "SELECT target_id, n, pattern, left(description, 35) AS risk, right(source, 35) AS source FROM js_unique WHERE n <= 20",
    "report_topn_meta": "SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY place, name) AS n, name, left(content, 80) AS content FROM meta_last QUALIFY n <= 15",
    "report_topn_forms": "SELECT DISTINCT target_id, form_no, action, method, has_csrf, coalesce(inputs, '') AS inputs FROM form_issues",
    "report_topn_cookies": "SELECT j.target_id, j.name, secure, httponly, samesite, left(coalesce(i.issues, ''), 60) AS issues FROM jar j LEFT JOIN (SELECT target_id, domain, path, name, string_agg(issue, '; ' ORDER BY n) AS issues FROM cookie_issues GROUP BY ALL) i USING (target_id, domain, path, name)",
    "report_topn_paths": "SELECT target_id, path, left(snippet, 100) AS preview FROM exposed",
    "module_error_rows": (
        "SELECT target_id, 'tool_report:' || tool AS module, line AS input FROM tool_report WHERE CASE WHEN json_valid(line) THEN json_type(line) <> CASE tool WHEN 'wp' THEN 'OBJECT' ELSE 'ARRAY' END ELSE true END"
        " UNION ALL SELECT target_id, 'openapi', path FROM (SELECT * FROM http_response UNION ALL SELECT * FROM api_broken) JOIN api_paths USING (path)"
        " WHERE status = 200 AND contains(content_type, 'application/json') AND NOT json_valid(body)"
        " UNION ALL SELECT target_id, 'graphql', path FROM (SELECT * FROM http_response UNION ALL SELECT * FROM api_broken) JOIN graphql_paths USING (path)"
        " WHERE status = 200 AND NOT json_valid(body)"
        " UNION ALL SELECT target_id, 'target', url FROM targets WHERE regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) = ''"
    ),
    "severity_windows": "SELECT (1700000000 + target_id) // 3600 * 3600 AS start, severity, count(*) AS n FROM page_findings GROUP BY ALL",
    "scan_stream": "SELECT * FROM page_findings",
    "findings_stream_sink": "SELECT * FROM page_each",
}


def _needs(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'(?:[^']|'')*'", "''", sql)))
    return [name for name in CTE if name in words]


def statement(final: str) -> str:
    """The final select with the expressions it needs, in order of use."""
    ordered: list[str] = []

    def add(name: str, path: tuple[str, ...]) -> None:
        if name in ordered or name in path:
            return
        for other in _needs(CTE[name]):
            if other != name:
                add(other, (*path, name))
        ordered.append(name)

    for name in _needs(final):
        add(name, ())
    if not ordered:
        return final
    recursive = any(n.endswith("_walk") for n in ordered)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered) + "\n" + final


ORACLE: dict[str, str] = {name: statement(final) for name, final in FINAL.items()}
