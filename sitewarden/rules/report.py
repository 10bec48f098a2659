"""Issue texts, severities and display limits of the report."""

# Severities in report order, bar width.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
BAR_WIDTH = 25

# Cookie issues.
COOKIE_INSECURE_HTTPS = "[INFO] Missing Secure flag — (Cookie sent over HTTPS anyway, but flag is missing)"
COOKIE_INSECURE_HTTP = "Missing Secure flag — cookie sent over HTTP"
COOKIE_NO_HTTPONLY = "[INFO] Missing HttpOnly flag — accessible via JS (Vulnerable only if XSS exists)"
COOKIE_NO_SAMESITE = "[INFO] Missing SameSite flag — (Modern browsers default to Lax)"
SAMESITE_DEFAULT = "Not Set"

# Form issues and words of an anti-forgery field.
FORM_NO_CSRF_GET = "[INFO] No CSRF token — but form uses GET (usually safe if it doesn't change state)"
FORM_NO_CSRF = "No CSRF token detected — vulnerable to Cross-Site Request Forgery"
FORM_PASSWORD_GET = "Password sent via GET — credentials visible in URL and logs"
FORM_OVER_HTTP = "Form submits over HTTP — credentials sent in plaintext"
FORM_EMPTY_ACTION = "[INFO] Empty/anchor form action — typically client-side UI (React/Vue/Framer)"
FORM_NO_ACTION = "(empty)"
CSRF_WORDS = ["csrf", "token", "_token", "xsrf"]

# Texts of ingested tool reports.
WP_NO_TITLE = "Unknown"
WP_NO_REFERENCE = "N/A"
WP_PLUGIN_NO_TITLE = "vuln"
WP_CLEAN_NAME = "WordPress Site Scanned"
WP_CLEAN_TEXT = "WordPress detected but no vulnerabilities found with current configuration."
GIT_NO_RULE = "Secret Found"
GIT_NO_FILE = "unknown"
GIT_NO_LINE = "?"
GIT_SEEN_NAME = "GitHub Repository Detected"

# Texts of the interface findings.
OPENAPI_NO_TITLE = "Unknown API"
OPENAPI_NO_VERSION = "1.0"
GRAPHQL_TEXT = "GraphQL Introspection is ENABLED! The entire database schema can be dumped."

# Display limits.
DNS_VALUES, CERT_NAMES, META_ROWS, JS_ROWS = 5, 10, 15, 20
JS_TEXT_WIDTH, FORM_INPUTS, SNIPPET_WIDTH, COOKIE_ISSUE_WIDTH, VALUE_WIDTH = 35, 8, 100, 60, 80

# Labels of the digest.
DIGEST_TARGET = "Target: "
DIGEST_TECH = "**Technologies détectées:** "
DIGEST_SECRETS = "**Secrets exposés:**"
DIGEST_JS = "**Vulnérabilités JS:**"
DIGEST_PATHS = "**Fichiers sensibles exposés:**"
DIGEST_HEADERS = "**Headers de sécurité manquants:**"
DIGEST_COOKIES = "**Cookies analysés:** "
DIGEST_INSECURE = " cookies avec problèmes de sécurité"
DIGEST_FILLER = "Peu de vulnérabilités détectées. Fournis tout de même des recommandations de sécurité générales."
DIGEST_SHORT, DIGEST_JS_ROWS = 100, 5
