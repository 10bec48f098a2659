"""Comment words, error texts and framework configuration keys."""

# Words that make an HTML comment suspicious.
COMMENT_WORDS = ["todo", "fixme", "hack", "bug", "password", "secret", "key", "token", "api", "debug", "temp", "remove"]

# Error and debug texts.
ERRORS = [
    r"(?i)stack\s*trace", r"(?i)traceback\s*\(most recent", r"(?i)fatal\s+error",
    r"(?i)uncaught\s+exception", r"(?i)syntax\s+error.*?line\s+\d+",
]

# A word (lower case) that occurs wherever an error text does.
ERROR_WORDS = ["stack", "traceback", "fatal", "uncaught", "syntax"]

# Source map reference.
SOURCE_MAP = r"//[#@]\s*sourceMappingURL=(\S+)"

# Fixed values: (label, pattern with the blob in group 1, a literal that has to occur in lower case).
CONFIG_BLOBS = [
    ("Nuxt.js Runtime Config", r"(?s)window\.__NUXT__\s*=\s*(\{.{20,}?\})", "window.__nuxt__"),
    ("Nuxt.js SSR Data", r"(?is)<script[^>]+id=[\"']__NUXT_DATA__[\"'][^>]*>([\s\S]{20,}?)</script>", "__nuxt_data__"),
    ("Next.js Build Data", r"(?is)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>([\s\S]{20,}?)</script>", "__next_data__"),
]
BLOB_LIMIT = 5000
SUMMARY_KEYS = 10

# Configuration keys and their severity, in report order.
CONFIG_KEYS = [
    ("baseUrl", "MEDIUM"),
    ("serverBaseUrl", "MEDIUM"),
    ("newBaseURL", "MEDIUM"),
    ("buildId", "INFO"),
    ("NODE_ENV", "INFO"),
    ("STRIPE_PMC_KEY_LIVE", "HIGH"),
    ("STRIPE_PMC_KEY_TEST", "MEDIUM"),
    ("STRIPE_BNPL_CONFIGURATION_LIVE", "HIGH"),
    ("STRIPE_DEFAULT_CONFIGURATION_LIVE", "HIGH"),
    ("ENTERPRISE_RECAPTCHA_SITE_KEY", "MEDIUM"),
    ("RECAPTCHA_SITE_KEY", "MEDIUM"),
    ("HLS_URL", "LOW"),
    ("REST_API_URLS", "MEDIUM"),
    ("STATS_API_URL", "MEDIUM"),
    ("paymentsServiceUrl", "MEDIUM"),
    ("cdnURL", "INFO"),
]


def key_pattern(key: str) -> str:
    """Pattern of ``"key": "value"`` with the value in group 1 (quotes around the key are optional)."""
    return r"[\"']?" + key + r"[\"']?\s*:\s*[\"']([^\"'{}]+)[\"']"
