"""Context rules that suppress a credential match."""

# Any of these in the context (case-insensitive) suppresses every rule.
GLOBAL_CONTEXT = [
    r"--token-", r"--color-", r"--font-", r"var\(--", r"csrf", r"nonce=", r"integrity=",
    r"data:image/", r"sourceMappingURL", r"\.woff", r"\.ttf", r"apbct-", r"cleantalk", r"poptin",
]

# F1, private address that looks like a version.
VERSION_CONTEXT = r"version|@\d|\"\d+\.\d+\.\d+"

# F2, words for JWT and Supabase matches.
STYLE_WORDS = ["font", "stylesheet", "css", "woff", "image"]

# F3, placeholder Google keys.
PLACEHOLDERS = ["EXAMPLE", "YOUR_API", "REPLACE"]

# F4, label words for Generic Secret values.
LABEL_WORDS = [
    "mot de passe", "nouveau mot de passe", "mot de passe actuel",
    "confirm password", "current password", "new password",
    "change password", "forgot password", "cancel",
    "passworddesc", "password description",
    "contraseña", "contraseña actual", "nueva contraseña",
    "confirmar contraseña", "cambiar contraseña",
    "email", "correo", "correo electrónico",
    "usuario", "nombre de usuario",
]

# F5 to F14 for Generic Secret: (number, regular expression on the context, ignore case).
GENERIC_CONTEXT = [
    ("F5", r"\baccess_token[\"']?\s*=\s*[\"']access_token[\"']", False),
    ("F6", r"password[\"']?\s*:\s*[\"'][^\"']{1,30}[\"']", False),
    ("F7", r"(password|username)\s*=\s*[\"']%filtered%[\"']", True),
    ("F8", r"statsigClientApiKey", False),
    ("F9", r"\bapiKey[\"']?\s*:\s*[\"'][A-Za-z0-9_-]{20,}", False),
    ("F10", r"\b(API_KEY|ApiKey)\s*=\s*\"[^\"]*_key\"", True),
    ("F11", r"\"%filtered%\"|'%filtered%'", False),
    ("F12", r"(FORGOT_PASSWORD|Password)\s*=\s*\"[^\"]*\"", True),
    ("F13", r"\bRESET_PASSWORD\s*=\s*\"[^\"]*\"", True),
    ("F14", r"(ApiKey|API_KEY)\s*=\s*\"\w+_\w+\"", True),
]
