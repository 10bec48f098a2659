"""Technology fingerprints and report categories."""

# Technology -> regular expressions, any of them, case-insensitive.
SIGNATURES = {
    "React": [r"react(?:\.min)?\.js", r"__NEXT_DATA__", r"_react", r"reactDOM", r"data-reactroot", r"data-reactid"],
    "Next.js": [r"__NEXT_DATA__", r"_next/static", r"next/dist", r"nextjs"],
    "Vue.js": [r"vue(?:\.min)?\.js", r"__vue__", r"v-bind", r"v-if", r"v-for", r"Vue\."],
    "Nuxt.js": [r"__NUXT__", r"nuxt", r"_nuxt/"],
    "Angular": [r"angular(?:\.min)?\.js", r"ng-app", r"ng-controller", r"ng-model", r"\[ngClass\]"],
    "Svelte": [r"svelte", r"__svelte"],
    "jQuery": [r"jquery(?:\.min)?\.js", r"\$\(document\)", r"\$\(function"],
    "Bootstrap": [r"bootstrap(?:\.min)?\.(?:js|css)", r"class=\".*?(?:container|row|col-)", r"btn btn-"],
    "Tailwind CSS": [r"tailwindcss", r"tailwind\.config", r"class=\".*?(?:flex|grid|text-|bg-|p-|m-|w-|h-)"],
    "WordPress": [r"wp-content", r"wp-includes", r"wp-json", r"wordpress"],
    "Django": [r"csrfmiddlewaretoken", r"django", r"__django"],
    "Laravel": [r"laravel", r"_token", r"csrf-token.*?content"],
    "Express.js": [r"X-Powered-By.*?Express"],
    "Flask": [r"Werkzeug", r"flask"],
    "Ruby on Rails": [r"X-Powered-By.*?Phusion", r"csrf-token", r"rails", r"turbolinks"],
    "ASP.NET": [r"__VIEWSTATE", r"__EVENTVALIDATION", r"asp\.net", r"X-AspNet-Version"],
    "PHP": [r"X-Powered-By.*?PHP", r"\.php", r"PHPSESSID"],
    "Cloudflare": [r"cf-ray", r"cloudflare", r"__cfduid"],
    "Vercel": [r"x-vercel", r"vercel", r"\.vercel\.app"],
    "Netlify": [r"x-nf-request-id", r"netlify"],
    "Firebase": [r"firebaseapp\.com", r"firebase\.js", r"firebaseio\.com"],
    "Supabase": [r"supabase", r"\.supabase\.co"],
    "Stripe.js": [r"js\.stripe\.com", r"stripe(?:\.min)?\.js", r"Stripe\("],
    "Google Analytics": [r"google-analytics\.com", r"gtag\(", r"GoogleAnalyticsObject", r"UA-\d{4,}-\d{1,}"],
    "Google Tag Manager": [r"googletagmanager\.com", r"GTM-[A-Z0-9]+"],
    "Hotjar": [r"hotjar\.com", r"_hjSettings"],
    "Sentry": [r"sentry\.io", r"Sentry\.init", r"@sentry"],
    "Webpack": [r"webpackJsonp", r"__webpack_require__", r"webpack"],
    "Vite": [r"@vite", r"vite/client", r"import\.meta\.env"],
}

# A word (lower case) that occurs wherever the fingerprint does, for fingerprints with operators.
REQUIRED = {
    r"react(?:\.min)?\.js": "react",
    r"vue(?:\.min)?\.js": "vue",
    r"angular(?:\.min)?\.js": "angular",
    r"jquery(?:\.min)?\.js": "jquery",
    r"bootstrap(?:\.min)?\.(?:js|css)": "bootstrap",
    r"stripe(?:\.min)?\.js": "stripe",
    r"UA-\d{4,}-\d{1,}": "ua-",
    r"GTM-[A-Z0-9]+": "gtm-",
}

# Report category -> technologies; a technology outside all lists is "Other".
CATEGORIES = {
    "Frontend": ["React", "Vue.js", "Angular", "Svelte", "jQuery", "Bootstrap", "Tailwind CSS"],
    "Framework": ["Next.js", "Nuxt.js", "Django", "Laravel", "Express.js", "Flask", "Ruby on Rails", "ASP.NET"],
    "Platform": ["WordPress", "Cloudflare", "Vercel", "Netlify", "Firebase", "Supabase"],
    "Build": ["Webpack", "Vite"],
    "Analytics": ["Google Analytics", "Google Tag Manager", "Hotjar", "Sentry"],
    "Payment": ["Stripe.js"],
    "Language": ["PHP"],
    "Vibe-Coding": ["Replit", "Lovable (GPT Engineer)", "Bolt.new", "v0.dev (Vercel)", "Cursor", "Windsurf (Codeium)",
                    "Create.xyz", "Tempo Labs", "Bubble.io", "Webflow", "Framer", "Wix", "Squarespace"],
}

# Fixed value: a link to a public code repository.
REPO_LINK = r"github\.com/[\w-]+/[\w.-]+"
REPO_LIMIT = 3
