"""Script sinks and calls."""

# Literal -> description.
SINKS = {
    "eval(": "Use of eval() — potential code injection",
    "document.write(": "document.write() — potential DOM XSS",
    "innerHTML": "innerHTML assignment — potential XSS",
    "setTimeout(String": "setTimeout with string — potential injection",
    "setInterval(String": "setInterval with string — potential injection",
    "location.href=": "Unvalidated redirect — potential open redirect",
    "window.location=": "Unvalidated redirect — potential open redirect",
    "document.cookie": "Direct cookie access in JS",
    "localStorage.": "LocalStorage usage — check for sensitive data",
    "sessionStorage.": "SessionStorage usage — check for sensitive data",
    "postMessage(": "postMessage — check origin validation",
}

# Calls with the address in group 1; limits.
FETCH_CALL = r"fetch\s*\(\s*['\"]([^'\"]+)['\"]"
XHR_CALL = r"\.open\s*\(\s*['\"][A-Z]+['\"]\s*,\s*['\"]([^'\"]+)['\"]"
CONTEXT_RADIUS = 40
CONTEXT_KEEP = 120
FINDING_CAP = 50

# Resource references inside scripts and manifests; limits.
BUILD_ID = r"\"buildId\"\s*:\s*\"([^\"]+)\""
MANIFEST_CHUNKS = [r"\"(/_next/static/[^\"]+\.js)\"", r"\"([^\"]+\.js)\""]
STATIC_REFERENCE = r"[\"']((?:/_next)?/static/(?:chunks|css|media)/[^\"']+\.(?:js|css))[\"']"
MANIFEST_LIMIT = 30
REFERENCE_LIMIT = 20
ARCHIVE_LIMIT = 15
MIN_BODY = 50
