"""Fixed values shared with existing data: stored names, word lists and formats.

Everything here must keep its exact spelling, because stored envelopes, masked
texts and policies already use these values.
"""

from __future__ import annotations

# --- fixed values: stored enum spellings -------------------------------------
MODE_REVERSIBLE = "reversible"
MODE_OPAQUE = "opaco"
MODE_DIRECT = "directo"
ROLE_ADMIN = "dios"
ROLE_PLUS = "angel"
ROLE_BASIC = "humano"
STATUS_PENDING = "pendiente"
STATUS_OK = "ok"
STATUS_ERROR = "error"
FORMAT_MARKDOWN = "markdown"
FORMAT_JSON = "json"
FORMAT_LLMS_TXT = "llms_txt"

# --- fixed values: role -> allowed modes, most private first -----------------
ALLOWED_MODES = {
    ROLE_ADMIN: (MODE_REVERSIBLE, MODE_OPAQUE, MODE_DIRECT),
    ROLE_PLUS: (MODE_REVERSIBLE, MODE_OPAQUE),
    ROLE_BASIC: (MODE_OPAQUE,),
}
DEFAULT_MODE = MODE_DIRECT
FALLBACK_MODES = (MODE_OPAQUE, MODE_REVERSIBLE, MODE_DIRECT)
ROLE_RANK = {ROLE_BASIC: 0, ROLE_PLUS: 1, ROLE_ADMIN: 2}

# --- fixed values: capabilities per role -------------------------------------
CAPABILITIES = {
    # role: (max_tier, proxy, capture, solver, crawl, paginate, data_tree)
    ROLE_ADMIN: (3, True, True, True, True, True, True),
    ROLE_PLUS: (2, True, True, False, True, True, False),
    ROLE_BASIC: (1, False, False, False, False, True, False),
}

# --- fixed values: meta keys that never leave the store ----------------------
SECRET_META_KEYS = (
    "proxy", "captcha_api_url", "captcha_api_key", "cookies", "cookies_browser",
    "callback_url", "owner_jti",
)
LOGGED_URL_COLUMNS = ("url", "seed", "source_url", "final_url", "callback_url")
DERIVED_META_KEYS = ("records", "api_urls", "files")

# --- fixed values: navigation path segments ----------------------------------
CHROME_SEGMENTS = (
    "login", "signin", "sign-in", "signup", "sign-up", "register", "registro", "registrate",
    "logout", "salir", "logoff", "cart", "carrito", "checkout", "account", "cuenta",
    "mi-cuenta", "myaccount", "help", "ayuda", "soporte", "support", "terms", "terminos",
    "tos", "privacy", "privacidad", "legal", "cookies", "feedback", "accesibilidad",
    "accessibility", "contact", "contacto", "about", "acerca", "sitemap", "rss", "share",
    "compartir", "print", "addresses", "notifications", "newsletter", "preferences", "ajustes",
)
CHROME_PATTERN = "(?i)(?:^|/)(?:" + "|".join(CHROME_SEGMENTS) + ")(?:[/?.#]|$)"
SKIPPED_HREF_PREFIXES = ("#", "mailto:", "javascript:", "tel:", "data:")

# --- fixed values: tracking, analytics and advertising URL marks -------------
TELEMETRY_MARKS = (
    r"melidata", r"/tracks?\b", r"o11y", r"otel", r"/v1/(?:metrics|traces|logs)",
    r"/collect\b", r"/beacon", r"analytics", r"google-?analytics", r"googletagmanager",
    r"/gtm", r"/gtag", r"doubleclick", r"segment\.", r"mixpanel", r"amplitude", r"sentry",
    r"datadog", r"newrelic", r"nr-data", r"hotjar", r"clarity\.ms", r"facebook\.com/tr",
    r"/pixel", r"/rum\b", r"/telemetry", r"cookielaw", r"onetrust", r"/csp-report",
    r"adtrafficquality", r"googlesyndication", r"googleads", r"adservice\.google",
    r"/getconfig/soda", r"/pagead", r"2mdn", r"gstatic\.com", r"recaptcha", r"/safeframe",
    r"criteo", r"taboola", r"outbrain", r"quantserve", r"scorecardresearch", r"adsystem",
    r"pubmatic", r"rubicon", r"casalemedia", r"adsrvr", r"adnxs", r"/aclk", r"/ads\?",
    r"smartadserver", r"teads", r"moatads", r"/prebid",
)
TELEMETRY_PATTERN = "(?i)(?:" + "|".join(TELEMETRY_MARKS) + ")"

# --- fixed values: file extensions per asset kind, caps per kind -------------
ASSET_EXTENSIONS = {
    "document": ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods", "odp", "rtf",
                 "epub", "csv", "tsv", "txt", "md", "json", "xml", "yaml", "yml"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "tgz"),
    "audio": ("mp3", "wav", "m4a", "ogg", "flac", "aac", "opus", "weba"),
    "video": ("mp4", "webm", "mkv", "mov", "avi", "m4v", "flv", "wmv"),
    "image": ("jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "tif", "tiff", "ico", "avif"),
}
ASSET_KINDS = ("document", "archive", "audio", "video", "image", "embed")
ASSET_CAPS = {"document": 200, "archive": 200, "audio": 200, "video": 200, "image": 300,
              "embed": 100}
VIEWER_MARKS = ("docs.google.com", "drive.google.com", "view.officeapps.live.com",
                "mozilla.github.io/pdf.js", "/viewer")
VIEWER_KEYS = ("url", "file", "src", "document")
VIEWER_NOTE = "visor desincrustado"

# --- fixed values: embed providers, first rule that matches wins -------------
EMBED_RULES = (
    ("youtube", "Video de YouTube", ("youtube.com/embed", "youtu.be/",
                                     "youtube-nocookie.com/embed")),
    ("vimeo", "Video de Vimeo", ("player.vimeo.com", "vimeo.com/video")),
    ("scribd", "Documento de Scribd", ("scribd.com/embeds", "scribd.com/doc")),
    ("slideshare", "Presentación de SlideShare", ("slideshare.net",)),
    ("gdocs", "Google Docs", ("docs.google.com", "drive.google.com")),
    ("soundcloud", "Audio de SoundCloud", ("soundcloud.com",)),
    ("spotify", "Spotify", ("spotify.com/embed",)),
)
DOWNLOADABLE_EMBEDS = ("youtube", "vimeo")

# --- fixed values: platform hosts (any subdomain counts) ---------------------
VIDEO_HOSTS = {
    "youtube.com": "youtube", "youtu.be": "youtube", "youtube-nocookie.com": "youtube",
    "vimeo.com": "vimeo", "dailymotion.com": "dailymotion", "dai.ly": "dailymotion",
    "twitch.tv": "twitch", "tiktok.com": "tiktok", "twitter.com": "twitter", "x.com": "twitter",
    "facebook.com": "facebook", "fb.watch": "facebook", "instagram.com": "instagram",
    "soundcloud.com": "soundcloud", "bandcamp.com": "bandcamp", "streamable.com": "streamable",
    "rumble.com": "rumble", "odysee.com": "odysee",
}
GALLERY_HOSTS = {
    "instagram.com": "instagram", "twitter.com": "twitter", "x.com": "twitter",
    "reddit.com": "reddit", "redd.it": "reddit", "pinterest.com": "pinterest",
    "pin.it": "pinterest", "tumblr.com": "tumblr", "flickr.com": "flickr",
    "deviantart.com": "deviantart", "imgur.com": "imgur", "artstation.com": "artstation",
    "behance.net": "behance", "weibo.com": "weibo", "vk.com": "vk", "500px.com": "500px",
    "nitter.net": "galería",
}
COMMENT_HOSTS = {
    "youtube.com": "youtube", "youtu.be": "youtube", "reddit.com": "reddit",
    "redd.it": "reddit", "twitter.com": "twitter", "x.com": "twitter", "tiktok.com": "tiktok",
}
EXPERIMENTAL_PLATFORMS = ("reddit", "twitter", "tiktok")
PROFILE_RESERVED = ("p", "reel", "reels", "tv", "explore", "stories", "accounts", "direct",
                    "about", "developer", "legal", "directory", "lite", "web", "graphql")
POST_SEGMENTS = ("p", "reel", "reels", "tv")

# --- fixed values: document types --------------------------------------------
DOCUMENT_TYPES = (
    "application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument",
    "application/vnd.ms-excel", "application/vnd.ms-powerpoint", "application/epub",
    "application/rtf", "application/vnd.oasis.opendocument",
)
DOCUMENT_SUFFIXES = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".epub",
                     ".rtf", ".odt", ".ods", ".odp")
DEFAULT_DOCUMENT_NAME = "documento"
DEFAULT_DOWNLOAD_NAME = "descarga"
FILENAME_CHARACTERS = r"A-Za-z0-9._\- ()"
FILENAME_LENGTH = 150
DOWNLOAD_EXTENSIONS = {
    "application/pdf": "pdf", "application/zip": "zip", "image/jpeg": "jpg",
    "image/png": "png", "image/gif": "gif", "image/webp": "webp", "audio/mpeg": "mp3",
    "video/mp4": "mp4", "text/csv": "csv",
}

# --- fixed values: personal-data types and placeholder names -----------------
PII_TYPES = ("EMAIL", "IP", "CUIT", "TARJETA", "TEL")
PLACEHOLDER_TYPES = {
    "<PRIVATE_PERSON>": "PERSONA", "<PRIVATE_ADDRESS>": "DOMICILIO",
    "<PRIVATE_EMAIL>": "EMAIL", "<PRIVATE_PHONE>": "TEL", "<ACCOUNT_NUMBER>": "ID",
    "<PRIVATE_DATE>": "FECHA", "<PRIVATE_URL>": "URL", "<SECRET>": "SECRETO",
    "<REDACTED>": "DATO",
}
DEFAULT_PII_TYPE = "DATO"
TOKEN_OPEN, TOKEN_CLOSE = "«", "»"

# --- fixed values: challenge marks per vendor, first match wins --------------
CAPTCHA_MARKS = (
    ("cloudflare", r"(?i)cf-chl|challenge-platform|/cdn-cgi/challenge|just a moment\.\.\."),
    ("recaptcha", r"(?i)g-recaptcha|recaptcha/api\.js|grecaptcha"),
    ("hcaptcha", r"(?i)\bh-captcha\b|hcaptcha\.com/captcha|js\.hcaptcha\.com"),
    ("datadome", r"(?i)captcha-delivery\.com|datadome"),
    ("perimeterx", r"(?i)px-captcha|_pxhd|human/challenge|perimeterx"),
    ("arkose", r"(?i)funcaptcha|arkoselabs"),
)
WAF_HEADERS = (("cf-mitigated", "cloudflare"), ("x-datadome", "datadome"),
               ("x-datadome-cid", "datadome"), ("x-px-", "perimeterx"))
BLOCK_STATUSES = (403, 429, 503)
MEDIA_LOGIN_MARKS = (
    "sign in to confirm", "sign in if", "not a bot", "use --cookies", "cookies-from-browser",
    "login required", "login_required", "private video", "members-only", "join this channel",
    "this video is only available", "account on this device",
)
COMMENT_LOGIN_MARKS = (
    "sign in to confirm", "confirm you're not a bot", "confirm you are not a bot",
    "use --cookies", "cookies-from-browser", "sign in to view", "login required",
    "this video may be inappropriate", "age-restricted", "members-only", "join this channel",
)

# --- fixed values: record field names, preferred first -----------------------
RECORD_FIELDS = {
    # field: (names in priority order, names preferred when digging for a scalar)
    "title": (("title", "name", "nombre", "titulo", "título", "headline", "label", "text"),
              ("text", "name", "label")),
    "price": (("current_price", "price", "amount", "precio", "monto", "value"),
              ("value", "amount", "number")),
    "url": (("permalink", "url", "link", "href", "enlace"), ("url", "href")),
    "id": (("id", "sku", "code", "codigo", "uid"), ("id",)),
}

# --- fixed values: healing of fields -----------------------------------------
HEAL_WEIGHTS = {"tag": 0.25, "el_id": 0.35, "classes": 0.25, "text": 0.15}
HEAL_MIN_SCORE = 0.45

# --- fixed values: output formats --------------------------------------------
LLMS_DEFAULT_TITLE = "Documento"
LLMS_SOURCE_LABEL = "Fuente"
BUNDLE_RULE = "\n\n---\n\n"
CONTENT_OPEN, CONTENT_CLOSE = "<<<CONTENIDO>>>", "<<<FIN_CONTENIDO>>>"
PAGE_PARAMS = ("page", "pagina", "p", "pg", "offset")

# --- fixed values: pagers ----------------------------------------------------
NEXT_WORDS = ("siguiente", "proxima", "próxima", "next")
NEXT_SIGNS = ("›", "»", ">")
POSTBACK_CALL = "__doPostBack"
PAGER_ARGUMENT = "Page$"
