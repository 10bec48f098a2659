"""Paths whose captured responses are classified."""

# Known sensitive paths.
SENSITIVE = [
    "/.env", "/.env.local", "/.env.production", "/.env.development",
    "/.git/config", "/.git/HEAD",
    "/.svn/entries",
    "/wp-config.php", "/wp-config.php.bak",
    "/config.php", "/configuration.php",
    "/.htaccess", "/.htpasswd",
    "/web.config",
    "/phpinfo.php",
    "/server-status", "/server-info",
    "/.DS_Store",
    "/robots.txt", "/sitemap.xml",
    "/crossdomain.xml",
    "/.well-known/security.txt",
    "/package.json", "/package-lock.json",
    "/composer.json", "/composer.lock",
    "/Gemfile", "/Gemfile.lock",
    "/Dockerfile", "/docker-compose.yml",
    "/.dockerignore",
    "/.gitignore",
    "/next.config.js", "/next.config.mjs",
    "/vite.config.js", "/vite.config.ts",
    "/nuxt.config.js", "/nuxt.config.ts",
    "/tsconfig.json", "/jsconfig.json",
    "/vercel.json", "/netlify.toml",
    "/firebase.json", "/.firebaserc",
    "/swagger.json", "/api-docs",
    "/graphql", "/.graphql",
    "/debug", "/trace",
    "/admin", "/administrator",
    "/backup.sql", "/dump.sql", "/database.sql",
    "/error.log", "/access.log", "/debug.log",
    "/.bash_history", "/.ssh/id_rsa",
    "/api/v1", "/api/v2",
    "/health", "/healthcheck", "/status",
    "/_next/static/", "/static/js/",
    "/source-map", "/.map",
    "/webpack.config.js",
]

# First list with a substring of the path gives the severity, else MEDIUM.
SEVERITY_BY_SUBSTRING = [
    ("CRITICAL", [".env", ".git", "config", "wp-config", "backup", ".ssh"]),
    ("HIGH", ["package.json", "docker", "composer"]),
    ("INFO", ["robots.txt", "sitemap.xml", "crossdomain.xml", "security.txt"]),
]

# Words of an error page; limits.
ERROR_WORDS = ["404", "not found", "page not found", "error"]
MIN_BODY = 10
SNIPPET = 200

# Paths of API descriptions and of GraphQL endpoints.
OPENAPI = [
    "/swagger.json", "/api/swagger.json", "/v1/swagger.json", "/v2/swagger.json",
    "/openapi.json", "/api/openapi.json", "/v3/api-docs", "/api-docs", "/v2/api-docs",
]
GRAPHQL = ["/graphql", "/api/graphql", "/v1/graphql", "/api/v1/graphql"]
