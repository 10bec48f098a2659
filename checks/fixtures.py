"""Planted input relations.

The given tables hold pages and prose but no response headers, cookies, forms or credentials. Every
relation below is derived by one SQL text from ``pages`` (all rows), so it grows with the table, and the
same text runs in Spark and in the checking engine. Values that look like credentials are put together
from md5 at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewarden.sources.captured import read_table

PAD = "repeat('<br> ', 40)"

# One positive per credential rule, in rule order; h is md5(page_id).
POSITIVES = [
    "'AKIA'||upper(substr(h,1,16))",
    "'aws_secret_access_key='||h||substr(h,1,8)",
    "'AIza'||h||substr(h,1,3)",
    "'ya29.'||h",
    "'sk_'||'live_'||substr(h,1,24)",
    "'pk_'||'live_'||substr(h,1,24)",
    "'sk_'||'test_'||substr(h,1,24)",
    "'pmc_'||substr(h,1,24)",
    "'sk-'||h",
    "'sk-'||'ant-'||h||substr(h,1,4)",
    "'sk-'||'or-v1-'||h||substr(h,1,16)",
    "'ghp_'||h||substr(h,1,4)",
    "'gho_'||h||substr(h,1,4)",
    "'glpat-'||substr(h,1,20)",
    "'xox'||'b-'||substr(h,1,12)",
    "'https://hooks.slack.com/services/T'||upper(substr(h,1,8))||'/B'||upper(substr(h,9,8))||'/'||substr(h,1,24)",
    "'https://discord.com/api/webhooks/'||cast(1000+page_id as string)||'/'||h",
    "'M'||substr(h,1,23)||'.'||substr(h,1,6)||'.'||substr(h,1,27)",
    "'SK'||h",
    "'AC'||h",
    "'SG.'||substr(h,1,22)||'.'||h||substr(h,1,11)",
    "'key-'||h",
    "'https://app-'||substr(h,1,8)||'.firebaseio.com'",
    "'firebase = \"AIza'||h||substr(h,1,3)||'\"'",
    "'heroku_api_key='||substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)",
    "'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.'||h||'.'||h",
    "'eyJ'||substr(h,1,20)||'.eyJ'||substr(h,1,20)||'.'||h",
    "'-----BEGIN '||'RSA PRIVATE KEY-----'",
    "'-----BEGIN '||'OPENSSH PRIVATE KEY-----'",
    "'-----BEGIN '||'PGP PRIVATE KEY BLOCK-----'",
    "'client_secret = ''' || h || ''''",
    "'postgres://u:'||substr(h,1,8)||'@db.internal/x'",
    "'10.'||cast(page_id % 250 as string)||'.3.4'",
    "'auth_token='||h||h",
    "'vercel_token='||h",
    "'netlify_token='||h",
    "'shpat_'||h",
    "'cloudflare api_key='||h||substr(h,1,8)",
    "'dop_v1_'||h||h",
    "'pk.eyJ'||h||'.'||h",
    "'sq0atp-'||substr(h,1,22)",
    "'paypal client_id=\"'||h||'\"'",
]

# (condition, snippet)
SNIPPETS = [
    ("page_id % 5 = 0", "'<form action=\"/login\" method=\"post\"><input name=\"u\" id=\"u1\"><input type=\"password\" name=\"p\"></form>'"),
    ("page_id % 5 = 1", "'<form action=\"http://x.example.com/s\" method=post><input type=''hidden'' name=csrf_token><input name=q></form>'"),
    ("page_id % 5 = 2", "'<form action=\"/find\"><input type=password name=p></form>'"),
    ("page_id % 5 = 3", "'<form><input name=\"q\"></form>'"),
    ("page_id % 4 = 0", "'<!-- TODO remove debug '||cast(page_id as string)||' -->'"),
    ("page_id % 4 = 1", "'<!--[if IE]> key <![endif]-->'"),
    ("page_id % 4 = 2", "'<script>var q=1;'||chr(10)||'//# sourceMappingURL=app'||cast(page_id as string)||'.js.map</script>'"),
    ("page_id % 4 = 3", "'<pre>Traceback (most recent call last): x</pre>'"),
    ("page_id % 3 = 0", "'<script>eval(x);a.innerHTML=y;localStorage.setItem(1,2);</script>'"),
    ("page_id % 3 = 1", "'<script>fetch(\"https://api.example.com/v'||cast(page_id as string)||'\");r.open(''GET'',''https://b.example.com/z'');</script>'"),
    ("page_id % 3 = 2", "'<script src=\"/js/a'||cast(page_id as string)||'.js\"></script><link rel=\"stylesheet\" href=\"css/m.css\">'"),
    ("page_id % 6 = 0", "'<meta name=\"generator\" content=\"WordPress 6.'||cast(page_id as string)||'\"><a href=\"https://github.com/acme/app-'||cast(page_id % 4 as string)||'\">r</a>'"),
    ("page_id % 6 = 1", "'<div data-framer=\"x\"></div>'"),
    ("page_id % 6 = 2", "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"buildId\":\"b'||cast(page_id as string)||'\",\"baseUrl\":\"https://i.example.com\",\"STRIPE_PMC_KEY_LIVE\":\"pmcval\"}</script>'"),
    ("page_id % 6 = 3", "'<p>Built with Lovable</p>'"),
    ("page_id % 6 = 4", "'<script>self.__NEXT_DATA__ = {\"buildId\":\"b'||cast(page_id as string)||'\"}</script>'"),
    ("page_id % 8 = 3", "'<!-- debug key glpat-'||substr(h,1,20)||' -->'"),
    ("page_id % 7 = 0", "'<script>password=\"abcdefgh'||cast(page_id as string)||'\"</script>'"),
    ("page_id % 7 = 1", "'<i integrity=\"x\" data-k=\"AKIA'||upper(substr(h,1,16))||'\"></i>'"),
    ("page_id % 50 = 49", "repeat('<i>10.1.2.3</i> ', 51)"),
]

PLANTED_HTML = (
    f"html || {PAD} || '<i>' || CASE page_id % 42 "
    + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(POSITIVES))
    + f" END || '</i>' || {PAD}"
    + "".join(f" || CASE WHEN {cond} THEN {sql} || {PAD} ELSE '' END" for cond, sql in SNIPPETS)
)

ID = "cast(page_id as string)"
MD5 = f"md5({ID})"
SITE = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0)"

RELATIONS = {
    "planted_pages": f"SELECT page_id, url, {PLANTED_HTML} AS html FROM (SELECT *, {MD5} AS h FROM pages) t",
    "page_meta": "SELECT page_id AS target_id, url, CASE WHEN page_id % 9 = 0 THEN url || '/home' ELSE url END AS final_url, cast(200 as int) AS status FROM pages",
    "http_header": (
        "SELECT page_id AS target_id, 'Strict-Transport-Security' AS name, 'max-age=31536000' AS value, cast(0 AS bigint) AS seq FROM pages WHERE page_id % 2 = 0"
        " UNION ALL SELECT page_id, 'content-security-policy', 'default-src ''self''', cast(1 AS bigint) FROM pages WHERE page_id % 3 = 0"
        " UNION ALL SELECT page_id, 'content-security-policy', 'base-uri ''none''', cast(2 AS bigint) FROM pages WHERE page_id % 6 = 0"
        " UNION ALL SELECT page_id, 'X-Frame-Options', 'DENY', cast(3 AS bigint) FROM pages WHERE page_id % 4 = 0"
        " UNION ALL SELECT page_id, 'Referrer-Policy', 'no-referrer', cast(4 AS bigint) FROM pages WHERE page_id % 5 = 0"
        " UNION ALL SELECT page_id, 'Server', 'nginx/1.' || cast(page_id % 20 as string), cast(5 AS bigint) FROM pages WHERE page_id % 5 = 1"
        " UNION ALL SELECT page_id, 'x-powered-by', 'PHP/8.1', cast(6 AS bigint) FROM pages WHERE page_id % 7 = 0"
        " UNION ALL SELECT page_id, 'x-powered-by', 'ASP.NET', cast(7 AS bigint) FROM pages WHERE page_id % 14 = 0"
    ),
    "set_cookie": (
        f"SELECT page_id AS target_id, cast(0 AS bigint) AS seq, url, 'sid=' || substr({MD5}, 1, 8) || '; Path=/' || CASE WHEN page_id % 2 = 0 THEN '; Secure' ELSE '' END"
        " || CASE WHEN page_id % 3 = 0 THEN '; HttpOnly' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '; SameSite=Lax' ELSE '' END AS set_cookie FROM pages"
        " UNION ALL SELECT page_id, cast(1 AS bigint), url, 'sid=again; Path=/; Secure; HttpOnly; SameSite=Strict' FROM pages WHERE page_id % 7 = 1"
        " UNION ALL SELECT page_id, cast(2 AS bigint), url, 'sid=other; Path=/other' FROM pages WHERE page_id % 7 = 2"
        " UNION ALL SELECT page_id, cast(3 AS bigint), url, 'sid=; Path=/; Max-Age=0' FROM pages WHERE page_id % 7 = 3"
        " UNION ALL SELECT page_id, cast(4 AS bigint), url, 'sid=back; Path=/; Max-Age=60' FROM pages WHERE page_id % 14 = 3"
        " UNION ALL SELECT page_id, cast(5 AS bigint), url, 'sid=; Path=/; Expires=Thu, 01 Jan 1970 00:00:00 GMT' FROM pages WHERE page_id % 7 = 4"
        " UNION ALL SELECT page_id, cast(6 AS bigint), url, 'track=1; Path=/; Domain=elsewhere.invalid' FROM pages WHERE page_id % 7 = 5"
    ),
    "http_response": (
        "SELECT page_id AS target_id, '/.env' AS path, CASE WHEN page_id % 2 = 0 THEN 200 ELSE 403 END AS status, 'text/plain' AS content_type, 'APP_MODE=prod' || chr(10) || 'REGION=eu' || CASE WHEN page_id % 4 = 2 THEN chr(10) || 'T=glpat-' || substr(md5('env' || cast(page_id as string)), 1, 20) ELSE '' END AS body FROM pages"
        f" UNION ALL SELECT page_id, '/.git/HEAD', 200, 'text/plain', CASE page_id % 3 WHEN 0 THEN 'ref: refs/heads/main' WHEN 1 THEN {MD5} || substr({MD5}, 1, 8) ELSE 'something else' END FROM pages"
        " UNION ALL SELECT page_id, '/.ssh/id_rsa', 200, 'text/plain', CASE WHEN page_id % 4 = 0 THEN '-----BEGIN ' || 'KEY-----' ELSE 'no key here at all' END FROM pages"
        " UNION ALL SELECT page_id, '/robots.txt', 200, 'text/plain', 'User-agent: *' || chr(10) || 'Disallow: /x' FROM pages WHERE page_id % 2 = 1"
        " UNION ALL SELECT page_id, '/package.json', 200, 'application/json', '{\"name\":\"app\",\"version\":\"1.0\"}' FROM pages WHERE page_id % 3 = 1"
        " UNION ALL SELECT page_id, '/admin', 200, 'text/html', '<!DOCTYPE html><p>login</p>' FROM pages"
        " UNION ALL SELECT page_id, '/status', 200, 'text/plain', 'page not found here' FROM pages"
        " UNION ALL SELECT page_id, '/dump.sql', 200, 'text/plain', 'short' FROM pages"
        " UNION ALL SELECT page_id, '/swagger.json', 200, 'application/json', CASE page_id % 3 WHEN 0 THEN '{\"swagger\":\"2.0\",\"info\":{\"title\":\"T\",\"version\":\"2\"},\"paths\":{\"/a\":{},\"/b\":{}},\"securityDefinitions\":{}}'"
        " WHEN 1 THEN '{\"openapi\":\"3.0.0\",\"paths\":{\"/a\":{}},\"components\":{\"securitySchemes\":{}}}' ELSE '{\"openapi\":\"3.0.0\",\"paths\":{}}' END FROM pages"
        " UNION ALL SELECT page_id, '/graphql', 200, 'application/json', CASE WHEN page_id % 2 = 0 THEN '{\"data\":{\"__schema\":{\"queryType\":{\"name\":\"Query\"}}}}' ELSE '{\"errors\":[]}' END FROM pages"
    ),
    # Interface answers that are no JSON, or are not read as such.
    "api_broken": (
        "SELECT page_id AS target_id, '/openapi.json' AS path, 200 AS status, 'application/json' AS content_type, CASE page_id % 3 WHEN 0 THEN '{\"openapi\": ' WHEN 1 THEN '' ELSE '[1, 2]' END AS body FROM pages"
        " UNION ALL SELECT page_id, '/api/graphql', CASE WHEN page_id % 2 = 0 THEN 200 ELSE 500 END, 'text/html', '<p>login</p>' FROM pages"
        " UNION ALL SELECT page_id, '/swagger.json', 200, 'text/plain', 'no description' FROM pages"
    ),
    "cert": (
        "SELECT page_id AS target_id, CASE WHEN page_id % 8 = 0 THEN 'ERROR' ELSE 'VALID' END AS status, CASE WHEN page_id % 8 = 0 THEN 'timed out' END AS error, 'CN=site' || cast(page_id as string) AS subject, 'TLSv1.3' AS version, 'A0' || cast(page_id as string) AS serial, 'CN=Test CA' AS issuer, 'Jan  1 00:00:00 2024 GMT' AS not_before,"
        " 'Jan  1 00:00:00 2025 GMT' AS not_after, 'alt' || cast(n as string) || '.example.com' AS alt_name, cast(n as bigint) AS pos FROM numbered WHERE n < 12"
        # A second certificate of some targets, captured twice.
        " UNION ALL SELECT page_id, 'VALID', cast(NULL as string), 'CN=new', 'TLSv1.3', 'B1', 'CN=Another CA', 'Jan  1 00:00:00 2025 GMT', 'Jan  1 00:00:00 2026 GMT', 'new.example.com', cast(n as bigint) FROM numbered WHERE n < 2 AND page_id % 9 = 1"
    ),
    "dns_record": (
        "SELECT page_id AS target_id, CASE n % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'MX' WHEN 3 THEN 'NS' ELSE 'TXT' END AS rtype, cast(n as bigint) AS pos,"
        f" 'v' || {ID} || '-' || cast(n as string) AS value FROM numbered WHERE n % 5 <> 0 OR page_id % 2 = 0"
        # Another answer, with two of the values again and a sixth.
        f" UNION ALL SELECT page_id, 'TXT', cast(100 + n as bigint), 'v' || {ID} || '-' || cast(n as string) FROM numbered WHERE n IN (4, 9, 12) AND page_id % 3 = 0"
    ),
    "whois": (
        "SELECT page_id AS target_id, 'Reg' || cast(page_id % 3 as string) AS registrar, '2020-01-01' AS creation, 'None' AS expiration, 'ns1,ns2' AS name_servers,"
        " CASE WHEN page_id % 2 = 0 THEN 'Acme' END AS org, '' AS country FROM pages"
    ),
    "archive_index": (
        "SELECT page_id AS target_id, '2019' || cast(1000 + n as string) AS ts, 'http://old.example.com/' || cast(n % 18 as string) || '.js' AS original,"
        " CASE WHEN n % 7 = 6 THEN 'text/html' ELSE 'application/javascript' END AS mimetype, 'com,example,old)/' || cast(n % 18 as string) || '.js' AS urlkey,"
        " CASE WHEN n % 6 = 5 THEN 404 ELSE 200 END AS status, '/* padding padding padding padding padding padding */ <i>' ||"
        f" CASE WHEN n = 1 THEN 'glpat-' || substr({MD5}, 1, 20) WHEN n = 2 THEN 'AKIA' || upper(substr({MD5}, 1, 16)) ELSE '' END || '</i>' AS content FROM numbered"
    ),
    # Copies of two files at several times: one value in copies 1, 2 and 4, one from the third on that some pages still show,
    # one in the last copy of the other file. Some copies were not answered with 200.
    "archive_history": (
        "SELECT page_id AS target_id, '2020' || cast(1000000000 + n as string) AS ts, 'http://old.example.com/config.js' AS original, 'application/javascript' AS mimetype, 'com,example,old)/config.js' AS urlkey,"
        " CASE WHEN n = 5 AND page_id % 3 = 0 THEN 503 ELSE 200 END AS status, '/* padding padding padding padding padding padding */ <i>' ||"
        f" CASE WHEN n IN (1, 2, 4) THEN 'glpat-' || substr(md5('gone' || {ID}), 1, 20) ELSE '' END || '</i>' || repeat('-', 100) || '<i>' ||"
        f" CASE WHEN n >= 3 THEN 'glpat-' || substr({MD5}, 1, 20) ELSE '' END || '</i>' AS content FROM numbered WHERE n BETWEEN 1 AND 6"
        " UNION ALL SELECT page_id, '2021' || cast(1000000000 + n as string), 'http://old.example.com/b.js', CASE WHEN n = 4 THEN 'text/html' ELSE 'application/javascript' END, 'com,example,old)/b.js', 200,"
        f" '/* padding padding padding padding padding padding */ <i>' || CASE WHEN n >= 3 THEN 'AKIA' || upper(substr({MD5}, 1, 16)) ELSE '' END || '</i>' FROM numbered WHERE n BETWEEN 1 AND 4"
    ),
    "resource_ref": (
        "SELECT page_id AS target_id, url AS base_url, CASE page_id % 4 WHEN 0 THEN 'https://cdn.example.com/a.js' WHEN 1 THEN '//cdn.example.com/b.js' WHEN 2 THEN '/js/c.js' ELSE 'd.js' END AS ref FROM pages"
    ),
    "resource_js": (
        f"SELECT page_id AS target_id, cast(0 as bigint) AS seq, 'inline' AS url, 'var a=1;eval(a);document.cookie;fetch(\"https://api.example.com/' || {ID} || '\");fetch(\"/local\");' AS content FROM pages"
        f" UNION ALL SELECT page_id, cast(1 as bigint), 'https://x.example.com/_next/static/b/_buildManifest.js', 'self.__M={{\"/\":[\"/_next/static/chunks/' || {ID} || '.js\",\"static/css/m.css\"],\"/a\":[\"c2.js\",\"http://h.example.com/z.js\"]}}' FROM pages"
        " UNION ALL SELECT page_id, cast(2 as bigint), 'https://x.example.com/m.js', 'import(\"/static/chunks/k' || cast(page_id % 5 as string) || '.js\");load(''/_next/static/css/s.css'');el.innerHTML=q;r.open(\"POST\",\"https://b.example.com/p\");window.location=u;eval(b)' FROM pages WHERE page_id % 2 = 0"
        " UNION ALL SELECT page_id, cast(3 as bigint), 'https://x.example.com/n.js', '// see https://github.com/acme/script-' || cast(page_id % 9 as string) || ' built with lovable.dev, framerusercontent.com' FROM pages WHERE page_id % 3 = 0"
    ),
    "tool_report": (
        "SELECT page_id AS target_id, 'wp' AS tool, CASE page_id % 4 WHEN 0 THEN '{\"target\":\"t\",\"vulnerabilities\":[{\"title\":\"V1\",\"description\":\"d\",\"references\":{\"url\":[\"http://r\"]}}],\"plugins\":{\"p1\":{\"vulnerabilities\":[{\"title\":\"PV\",\"description\":\"pd\"}]},\"p2\":{}}}'"
        " WHEN 1 THEN '{\"target\":\"t\"}' WHEN 2 THEN 'not json' ELSE '{\"other\":1}' END AS line FROM pages"
        " UNION ALL SELECT page_id, 'git', CASE page_id % 3 WHEN 0 THEN '[{\"RuleID\":\"r1\",\"File\":\"f.py\",\"StartLine\":3},{\"File\":\"g.py\"}]' WHEN 1 THEN '[]' ELSE 'broken' END FROM pages"
    ),
    "resource_body": (
        "SELECT page_id AS target_id, 'https://x.example.com/static/chunks/k' || cast(page_id % 5 as string) || '.js' AS url, CASE WHEN page_id % 10 = 8 THEN 404 ELSE 200 END AS status, 'var k=1;' || repeat('x', 60) AS content FROM pages"
        " UNION ALL SELECT page_id, 'https://x.example.com/_next/static/css/s.css', 200, 'p{}' || repeat(' ', 60) FROM pages"
        f" UNION ALL SELECT page_id, 'https://x.example.com/_next/static/chunks/' || {ID} || '.js', 200, CASE WHEN page_id % 3 = 0 THEN 'tiny' ELSE 'var c=2;' || repeat('y', 60) END FROM pages"
        " UNION ALL SELECT page_id, 'https://cdn.example.com/a.js', 200, 'var a=3;' || repeat('z', 60) FROM pages"
        # What the pages lead to: a linked script, a chunk that it names, and one a step further, which is not followed.
        f" UNION ALL SELECT page_id, {SITE} || '/js/a' || {ID} || '.js', 200, 'import(\"/_next/static/chunks/two' || {ID} || '.js\");eval(a)' || repeat('a', 60) FROM pages"
        f" UNION ALL SELECT page_id, {SITE} || '/_next/static/chunks/two' || {ID} || '.js', CASE WHEN page_id % 15 = 14 THEN 404 ELSE 200 END,"
        f" 'import(\"/_next/static/chunks/three' || {ID} || '.js\");t <i>glpat-' || substr(md5('two' || {ID}), 1, 20) || '</i>' || repeat(' ', 60) FROM pages"
        f" UNION ALL SELECT page_id, {SITE} || '/_next/static/chunks/three' || {ID} || '.js', 200, 't <i>glpat-' || substr(md5('three' || {ID}), 1, 20) || '</i>;eval(a)' || repeat(' ', 60) FROM pages"
        f" UNION ALL SELECT page_id, {SITE} || '/_next/static/b' || {ID} || '/_buildManifest.js', 200, 'self.__M={{\"/\":[\"static/chunks/m' || {ID} || '.js\"]}}' FROM pages WHERE page_id % 2 = 0"
        f" UNION ALL SELECT page_id, {SITE} || '/_next/static/chunks/m' || {ID} || '.js', 200, 'load(\"/_next/static/css/n.css\");document.cookie;//# sourceMappingURL=m.map' || repeat(' ', 60) FROM pages"
        f" UNION ALL SELECT page_id, {SITE} || '/_next/static/css/n.css', 200, 'p{{}} <i>AKIA' || upper(substr(md5('n' || {ID}), 1, 16)) || '</i>' || repeat(' ', 60) FROM pages"
    ),
}
# An inline script that names the framework data object and its build id (besides two that do not).
RELATIONS["build_script"] = (
    "SELECT page_id AS target_id, cast(2000000 as bigint) AS seq, 'inline' AS url, CASE page_id % 3 WHEN 0 THEN 'self.__NEXT_DATA__ = {\"buildId\" : \"b'"
    f" || {ID} || '\"}}' WHEN 1 THEN 'var d = {{\"buildId\":\"none\"}}' ELSE 'self.__NEXT_DATA__ = 1' END AS content FROM pages"
)

# Pages that link one or two code repositories.
RELATIONS["linked_pages"] = (
    "SELECT page_id, url, html || '<a href=\"https://github.com/acme/app-' || cast(page_id % 4 as string) || '\">r</a>'"
    " || CASE WHEN page_id % 4 = 0 THEN '<a href=\"https://github.com/acme/lib.js\">l</a>' ELSE '' END AS html FROM pages WHERE page_id % 2 = 0"
    " UNION ALL SELECT page_id, url, html FROM pages WHERE page_id % 2 <> 0"
)

# ``numbered``: every page with the 25 keys of ``nation`` (0..24).
NUMBERED_SQL = "SELECT pages.*, n_nationkey AS n FROM pages, nation"


def planted_html(pages: DataFrame) -> DataFrame:
    """Pages, batch or stream, with the planted snippets."""
    return pages.withColumn("h", F.expr(MD5)).withColumn("html", F.expr(PLANTED_HTML)).drop("h")


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One planted relation as a DataFrame over the given tables."""
    pages = read_table(spark, sf_dir, "pages")
    sql = RELATIONS[name].replace("{", "{{").replace("}", "}}")
    if "FROM numbered" in sql:
        numbered = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
        return spark.sql(sql.replace("FROM numbered", "FROM {numbered}"), numbered=numbered)
    return spark.sql(sql.replace("FROM pages", "FROM {pages}"), pages=pages)
