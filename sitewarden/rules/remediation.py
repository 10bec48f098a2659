"""Advice per kind of finding."""

# Credential rule -> advice.
SECRET_ADVICE = {
    "AWS Access Key": "1. IMMEDIATELY rotate in AWS IAM Console → Users → Security credentials.\n2. Use AWS Secrets Manager or SSM Parameter Store.\n3. Never hardcode — use IAM roles for EC2/Lambda.\n4. Enable CloudTrail to audit what the leaked key accessed.",
    "AWS Secret Key": "Same as AWS Access Key — rotate both together in IAM Console.",
    "Google API Key": "1. Go to Google Cloud Console → APIs & Services → Credentials.\n2. Add HTTP referrer restrictions (your domain only).\n3. Add API restrictions (only enable needed APIs).\n4. For sensitive APIs (Cloud, AI), use server-side service accounts instead.\n5. Rotate the key after restricting.",
    "Stripe Secret Key": "1. IMMEDIATELY rotate in Stripe Dashboard → Developers → API Keys → Roll Key.\n2. Secret keys must NEVER be in frontend code.\n3. Use server-side API route as proxy (e.g., /api/stripe/charge).\n4. Enable Stripe webhook signatures for server verification.",
    "Stripe Publishable Key": "Publishable keys are designed for frontend, but:\n1. Ensure no secret key is also exposed.\n2. Set up domain restrictions in Stripe Dashboard.\n3. Monitor for unexpected charges.",
    "OpenAI API Key": "1. Rotate at platform.openai.com → API Keys → Create new → Delete old.\n2. Create a server-side proxy: /api/ai/chat → forwards to OpenAI.\n3. Set usage limits in OpenAI dashboard.\n4. Use per-project keys with minimal permissions.",
    "Anthropic API Key": "1. Rotate at console.anthropic.com → API Keys.\n2. Build a backend proxy endpoint.\n3. Set workspace spending limits.\n4. Never expose in client-side JavaScript bundles.",
    "OpenRouter API Key": "1. Rotate at openrouter.ai → Settings → API Keys.\n2. Create a backend proxy endpoint.\n3. Set per-model and total spending limits.\n4. Use separate keys per environment.",
    "GitHub Token": "1. Revoke at GitHub → Settings → Developer settings → Personal access tokens.\n2. Use fine-grained tokens with minimal scope and expiry.\n3. For CI/CD, use GITHUB_TOKEN (automatic, scoped to repo).\n4. Store in GitHub Actions secrets, not code.",
    "Slack Token": "1. Revoke at api.slack.com → Your Apps → OAuth & Permissions.\n2. Use proper OAuth 2.0 flow instead of hardcoded tokens.\n3. Request minimum scopes needed.\n4. Rotate regularly.",
    "Discord Webhook": "1. Delete webhook in Discord Server Settings → Integrations.\n2. Create a new webhook URL.\n3. Never expose webhook URLs in client-side code.\n4. Use server-side proxy to post messages.",
    "Discord Bot Token": "1. Regenerate at discord.com/developers → Bot → Reset Token.\n2. Store in environment variables only.\n3. Grant minimum permissions (principle of least privilege).",
    "Database URL": "1. IMMEDIATELY change database password.\n2. Move connection string to server-side environment variables.\n3. Use connection pooling (PgBouncer, etc.) with restricted user.\n4. Enable SSL for database connections.\n5. Restrict DB access to application server IPs only.",
    "JWT Token": "1. Invalidate the token (add to blocklist or change signing secret).\n2. Implement proper token rotation with short expiry (15-30 min).\n3. Store in HttpOnly, Secure, SameSite cookies — never localStorage.\n4. Use strong signing secrets (256+ bits).",
    "Firebase API Key": "1. Set proper Firestore Security Rules (deny by default).\n2. Set proper Realtime Database rules.\n3. Restrict API key in Google Cloud Console.\n4. API key alone shouldn't grant access if rules are correct — but verify rules!",
    "Firebase URL": "1. Set security rules: { \".read\": \"auth != null\", \".write\": \"auth != null\" }\n2. Never use { \".read\": true } in production.\n3. Validate all data writes with rules.\n4. Use Firebase App Check for additional protection.",
    "SendGrid API Key": "1. Revoke in SendGrid → Settings → API Keys.\n2. Create new key with minimum permissions (Mail Send only).\n3. Use server-side only — never expose in frontend.",
    "Twilio API Key": "1. Revoke at twilio.com → Console → API Keys.\n2. Create new key with minimum permissions.\n3. Enable geographic permissions to prevent premium SMS abuse.",
    "Supabase Key": "1. Enable Row Level Security (RLS) on ALL tables.\n2. Write proper RLS policies for each table.\n3. The anon key is public by design, but RLS must protect data.\n4. Use service_role key only server-side.\n5. Test: can an anonymous user read/write data they shouldn't?",
    "Heroku API Key": "1. Rotate at Heroku Dashboard → Account Settings → API Key → Regenerate.\n2. Use Heroku CLI auth (heroku login) instead of hardcoded keys.\n3. Store in environment variables (heroku config:set).",
    "Mapbox Token": "1. Rotate at mapbox.com → Account → Access tokens.\n2. Set URL restrictions on the token.\n3. Use separate tokens for dev/prod.",
}
SECRET_DEFAULT = "1. Remove from source code IMMEDIATELY.\n2. Store in environment variables (.env) loaded server-side only.\n3. Create a backend API proxy so the key never reaches the browser.\n4. Rotate the compromised credential at the provider's dashboard.\n5. Audit logs for unauthorized usage during exposure period."

# Path -> advice.
PATH_ADVICE = {
    "/.env": "Block access via web server config. Add .env to .gitignore.",
    "/.git/config": "Block /.git/ path in web server. Remove .git from deployment.",
    "/package.json": "Remove from public access or restrict path.",
    "/robots.txt": "Review entries — don't list truly sensitive paths here.",
}
PATH_DEFAULT = "Block public access via web server configuration (nginx/apache)."

# Script sink -> advice.
SINK_ADVICE = {
    "eval(": "Replace eval() with JSON.parse() for JSON, or use Function() with strict input validation. Never pass user input to eval().",
    "innerHTML": "Use textContent instead of innerHTML for plain text. If HTML needed, sanitize with DOMPurify.before(message) before innerHTML assignment.",
    "document.write(": "Replace with document.createElement() + appendChild(), or innerHTML with prior sanitization. Modern code should never use document.write().",
    "location.href=": "Validate URLs against an allowlist. Use URL.parse() to check hostname before assignment to location.href.",
    "document.cookie": "Ensure all session cookies have HttpOnly and Secure flags. Audit what data is stored in cookies vs localStorage.",
    "localStorage.": "Don't store sensitive data in localStorage. Use sessionStorage for temporary data, or encrypt sensitive data before storage.",
    "sessionStorage.": "Same as localStorage - don't store sensitive data without encryption. Clear sessionStorage on logout.",
    "postMessage(": "Always validate event.origin in message listener: if (e.origin !== 'https://trusted.com') return;. Don't use '*' as targetOrigin.",
}
