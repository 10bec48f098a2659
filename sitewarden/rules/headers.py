"""Response headers that are expected, and headers that tell too much."""

# Header -> (severity when missing, description, patch).
EXPECTED = {
    "Strict-Transport-Security": (
        "HIGH", "Enforces HTTPS connections, preventing SSL stripping attacks.",
        "Add header: Strict-Transport-Security: max-age=31536000; includeSubDomains; preload"),
    "Content-Security-Policy": (
        "HIGH", "Prevents XSS, clickjacking, and other code injection attacks.",
        "Add header: Content-Security-Policy: default-src 'self'; script-src 'self'; style-src 'self' 'unsafe-inline'; img-src 'self' data:; font-src 'self'"),
    "X-Content-Type-Options": (
        "MEDIUM", "Prevents MIME-type sniffing attacks.",
        "Add header: X-Content-Type-Options: nosniff"),
    "X-Frame-Options": (
        "INFO", "Prevents clickjacking attacks by controlling iframe embedding.",
        "Add header: X-Frame-Options: DENY (or SAMEORIGIN if iframes are needed)"),
    "X-XSS-Protection": (
        "INFO", "Legacy XSS filter (deprecated but still useful for older browsers).",
        "Add header: X-XSS-Protection: 1; mode=block"),
    "Referrer-Policy": (
        "INFO", "Controls how much referrer information is sent with requests.",
        "Add header: Referrer-Policy: strict-origin-when-cross-origin"),
    "Permissions-Policy": (
        "INFO", "Controls which browser features the site can use.",
        "Add header: Permissions-Policy: camera=(), microphone=(), geolocation=()"),
}

# Header -> risk text when it carries a value.
TELLING = {
    "Server": "Server version disclosure",
    "X-Powered-By": "Technology disclosure",
}
