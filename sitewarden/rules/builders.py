"""Site builders and AI coding tools."""

# Tool -> regular expressions, first hit in list order wins, case-insensitive.
SIGNATURES = {
    "Replit": [
        r"replit\.dev", r"repl\.co", r"\.repl\.co", r"replit-badge", r"replit\.com", r"x-replit", r"__replit",
        r"replit-dev-domain", r"pid1\.replit", r"replitusercontent\.com",
    ],
    "Lovable (GPT Engineer)": [
        r"lovable\.dev", r"lovable\.app", r"gptengineer\.app", r"gptengineer", r"Built with Lovable",
        r"built-with-lovable", r"data-lovable", r"lovableproject", r"\.lovable\.", r"lovable-tagger",
    ],
    "Bolt.new": [r"bolt\.new", r"stackblitz\.com", r"bolt-generated", r"webcontainer", r"built.withbolt"],
    "v0.dev (Vercel)": [r"v0\.dev", r"v0-generated", r"generated by v0", r"Built with v0", r"v0\.dev/chat"],
    "Cursor": [r"cursor\.sh", r"cursor\.com", r"generated.by.cursor", r"cursorapi", r"cursor-composer"],
    "Windsurf (Codeium)": [r"windsurf", r"codeium\.com", r"windsurf\.ai", r"codeium"],
    "Create.xyz": [r"create\.xyz", r"createxyz", r"created-with-create", r"\.create\.xyz"],
    "Tempo Labs": [r"tempo\.new", r"tempolabs\.ai", r"tempo-generated", r"tempolabs"],
    "Firebase Studio (Project IDX)": [r"idx\.dev", r"project-idx", r"idx\.google\.com", r"firebase\.studio"],
    "Bubble.io": [r"bubble\.io", r"bubbleapps\.io", r"bubble-page", r"\.bubbleio\.", r"bdk\.bubble", r"bubble_page_load"],
    "Webflow": [
        r"webflow\.com", r"webflow\.io", r"wf-page", r"w-richtext", r"w-embed", r"data-wf-domain", r"data-wf-page",
        r"Webflow", r"webflow-badge",
    ],
    "Framer": [
        r"framer\.com", r"framer\.app", r"framerusercontent\.com", r"data-framer", r"framer-motion",
        r"\.framer\.wiki", r"\.framer\.website",
    ],
    "Wix": [
        r"wix\.com", r"wixsite\.com", r"wix-code", r"wixpress\.com", r"X-Wix-", r"static\.parastorage\.com",
        r"_wixCIDX", r"wix-thunderbolt",
    ],
    "Squarespace": [r"squarespace\.com", r"sqsp\.net", r"squarespace-cdn", r"sqs-", r"data-squarespace"],
    "Softr": [r"softr\.io", r"softr\.app", r"softr-embed", r"\.softr\."],
    "Glide": [r"glideapp\.io", r"glide\.page", r"glideapps\.com", r"heyglide"],
    "FlutterFlow": [r"flutterflow\.io", r"flutterflow\.app", r"app\.flutterflow", r"ff_theme"],
    "Retool": [r"retool\.com", r"retool\.dev", r"tryretool\.com", r"retoolcdn"],
    "Vercel AI SDK": [r"ai\.vercel\.dev", r"@ai-sdk", r"vercel/ai", r"useChat\(", r"useCompletion\(", r"streamText\("],
    "Supabase + AI": [r"supabase\.co.*?anon.*?key", r"NEXT_PUBLIC_SUPABASE", r"VITE_SUPABASE", r"createClient\(.*supabase"],
    "GitHub Copilot": [r"copilot-generated", r"github\.copilot", r"Generated by GitHub Copilot"],
    "Devin": [r"devin\.ai", r"cognition\.ai", r"devin-generated"],
    "Netlify Drop / Build": [r"netlify\.app", r"netlify-cms", r"netlify-identity", r"goatcounter.*netlify"],
    "Railway": [r"railway\.app", r"railway\.com", r"up\.railway\.app"],
    "Render": [r"onrender\.com", r"render\.com"],
}

# Tool -> (description, risk).
ABOUT = {
    "Replit": (
        "Replit — Cloud IDE with AI-assisted coding (Replit Agent / Ghostwriter)",
        "Replit deployments often expose .replit config, may have default CORS policies, and AI-generated code frequently contains hardcoded secrets or insecure patterns."),
    "Lovable (GPT Engineer)": (
        "Lovable (formerly GPT Engineer) — AI full-stack app builder",
        "Lovable apps often ship with exposed Supabase keys, default auth configs, and AI-generated code that may lack input validation or proper error handling."),
    "Bolt.new": (
        "Bolt.new (StackBlitz) — AI-powered full-stack web app builder",
        "Bolt.new generates complete apps rapidly; common issues include exposed API keys in client-side code, missing auth middleware, and insecure default configurations."),
    "v0.dev (Vercel)": (
        "v0.dev — Vercel's AI UI component generator",
        "v0 generates UI components that may be integrated without security review. Components may use dangerouslySetInnerHTML or lack input sanitization."),
    "Cursor": (
        "Cursor — AI-first code editor with Composer & Agent",
        "Cursor-generated code may contain AI hallucinated patterns, insecure defaults, or hardcoded development credentials left in production."),
    "Windsurf (Codeium)": (
        "Windsurf (Codeium) — AI-powered IDE with Cascade agent",
        "Similar to Cursor — AI-generated code may contain security anti-patterns, especially in auth flows and API integrations."),
    "Create.xyz": (
        "Create.xyz — AI app builder with natural language",
        "Apps generated via Create.xyz may have minimal security hardening, exposed API routes, and client-side secrets."),
    "Tempo Labs": (
        "Tempo Labs — AI-powered React visual editor",
        "Tempo-generated React code may include insecure component patterns or exposed configuration data."),
    "Firebase Studio (Project IDX)": (
        "Firebase Studio (formerly Project IDX) — Google's AI-powered cloud IDE",
        "May expose Firebase config, default security rules, or AI-generated backend code with insufficient access control."),
    "Bubble.io": (
        "Bubble.io — No-code visual web app builder",
        "Bubble apps may expose data via poorly configured privacy rules, and API Connector configurations may leak third-party credentials."),
    "Webflow": (
        "Webflow — Visual web design and CMS platform",
        "Webflow sites may expose form submission endpoints, CMS API keys, or custom code embeds with hardcoded secrets."),
    "Framer": (
        "Framer — Design-to-code website builder",
        "Framer sites may include custom code overrides with exposed API keys or insecure third-party integrations."),
    "Wix": (
        "Wix — Website builder platform",
        "Wix sites may have exposed Velo (Wix Code) backend functions, misconfigured data collections, or third-party app API leaks."),
    "Squarespace": (
        "Squarespace — Website builder and hosting platform",
        "Custom code injections in Squarespace may contain hardcoded API keys or insecure form handling."),
    "Softr": (
        "Softr — No-code app builder (Airtable-powered)",
        "Softr apps may expose Airtable API keys, base IDs, or misconfigured data access permissions in client-side code."),
    "Glide": (
        "Glide — No-code app builder from spreadsheets",
        "Glide apps may expose Google Sheets IDs or Airtable connections in client-side requests."),
    "FlutterFlow": (
        "FlutterFlow — Visual app builder for Flutter",
        "FlutterFlow apps may contain hardcoded Firebase configs, API keys in generated Dart/JS code, and default security rules."),
    "Retool": (
        "Retool — Low-code internal tools builder",
        "Retool deployments may expose database connection strings, API configurations, or admin panel access if improperly secured."),
    "Vercel AI SDK": (
        "Vercel AI SDK — Framework for building AI-powered apps",
        "Apps using Vercel AI SDK may expose LLM API keys (OpenAI, Anthropic) in client-side code or have unprotected AI endpoints."),
    "Supabase + AI": (
        "Supabase integration (common in vibe-coded apps)",
        "Exposed Supabase anon keys with permissive RLS policies allow unauthorized data access. Common in Lovable/Bolt/Replit generated apps."),
    "GitHub Copilot": (
        "GitHub Copilot — AI pair programmer",
        "Copilot may suggest code with known vulnerabilities, hardcoded example credentials, or insecure patterns from training data."),
    "Devin": (
        "Devin — Autonomous AI software engineer by Cognition",
        "Devin-generated code may contain autonomous decisions about security configurations that haven't been human-reviewed."),
    "Netlify Drop / Build": (
        "Netlify — Platform often used for deploying vibe-coded projects",
        "Netlify deployments may expose environment variables via _redirects, netlify.toml, or client-side build artifacts."),
    "Railway": (
        "Railway — Cloud deployment platform popular with vibe coders",
        "Railway deployments may expose internal service URLs, database connection strings, or Redis URLs in client-side code."),
    "Render": (
        "Render — Cloud application platform",
        "Render deployments may expose internal service hostnames or database URLs in frontend code."),
}

# A word (lower case) that occurs wherever the fingerprint does, for fingerprints with operators.
REQUIRED = {
    r"built.withbolt": "withbolt",
    r"generated.by.cursor": "cursor",
}

# Evidence radius and cut.
EVIDENCE_RADIUS = 40
EVIDENCE_KEEP = 120
