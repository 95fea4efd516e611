"""Patterns and word lists that decide results.

Every value below has to equal the published one for results to agree, so they
are kept together here as plain text and used by name elsewhere. Java regex
notes: ``\\z`` stands for a strict end of text, ``(?i)`` for case-insensitive
ASCII matching, ``(?iu)`` for case-insensitive Unicode matching.
"""

# ---- fixed values: URL and identifier shapes -------------------------------
URL = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
HEX_RUN = r"(?i)^[0-9a-f]{16,}\z"
TOKEN = r"^[A-Za-z0-9_-]{16,}\z"
SEGMENT_EXTENSION = r"\.([A-Za-z][A-Za-z0-9]{0,4})\z"
FILE_EXTENSION = r"\.([A-Za-z0-9]{1,8})\z"
PLACEHOLDER = r"<[A-Z][A-Z0-9_]*>"
SCRIPTED_HREF = r"(?i)^(?:javascript|data|blob|mailto|tel|sms|about|vbscript):"
ROUTED_FRAGMENT = r"^#!?/"
LOGOUT_PATH = r"(?i)(^|[/?#_-])(logout|signout|sign-out|log-out)([/?#_-]|\z)"
LOGIN_PATH = r"(?i)(^|[/?#_-])(login|signin|sign-in|log-in|auth)([/?#_-]|\z)"
LOGOUT_TEXT = r"(?i)\b(log ?out|sign ?out)\b"
LOGIN_TEXT = r"(?i)\b(log ?in|sign ?in)\b"

# ---- fixed values: extensions and media types ------------------------------
STATIC_EXTENSIONS = (
    "js", "mjs", "cjs", "css", "map", "png", "jpg", "jpeg", "gif", "svg", "webp", "avif", "ico", "bmp",
    "woff", "woff2", "ttf", "otf", "eot",
)
STATIC_MIME = (
    r"(?i)javascript|ecmascript|text/css|^image/|^font/|x-font|font-|ms-fontobject|opentype|truetype"
)
DOCUMENT_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "csv", "ppt", "pptx", "zip", "txt", "json", "xml", "rtf", "odt", "ods",
)
KNOWN_EXTENSIONS = DOCUMENT_EXTENSIONS + (
    "htm", "html", "md", "tsv", "log", "ics", "vcf", "eml", "msg", "epub", "odp", "xlsm", "xlsb", "docm", "pptm",
    "png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "tif", "tiff", "mp3", "mp4", "wav", "webm", "mov", "avi",
    "gz", "tar", "tgz", "7z", "rar", "bin", "dat", "exe", "msi", "dmg", "apk",
)
BINARY_DOCUMENT_MIME = (
    r"(?i)^application/(pdf|zip|x-zip-compressed|octet-stream|msword|vnd\.ms-|vnd\.openxmlformats-officedocument\.)"
)

# ---- fixed values: parameter and verb vocabularies -------------------------
PAGING_EXACT = (
    "page", "pg", "pageno", "pagenum", "pagenumber", "pageindex", "pagesize", "perpage", "currentpage",
    "offset", "limit", "size", "start", "skip", "top", "cursor",
)
PAGING_ANYWHERE = ("page", "paging", "pagination", "offset", "cursor", "limit", "skip")
PAGING_UNIT = ("size", "start", "count", "max", "first", "last")
PAGING_NOUN = ("row", "rows", "record", "records", "result", "results", "item", "items", "index", "batch")
POSITION_WORD = r"(?i)page(?!\s*size)|offset|start|skip|cursor|token|after|before|from"
SIZE_WORD = r"(?i)size|limit|per\s*page|top|count|max|rows"
WRITE_METHODS = ("PUT", "PATCH", "DELETE")
READ_METHODS = ("GET", "HEAD", "OPTIONS")
WRITE_VERB = (
    r"(?i)^(?:update|upd|delete|del|remove|submit|cancel|withdraw|approve|reject|upload|pay|payment|confirm"
    r"|finali[sz]e|revoke|mark|set|patch|put|post|create|insert|discard|file|lodge)\z"
)
OPERATION_KEY = (
    r"(?i)^(?:service(?:name)?|action(?:name)?|operation(?:name)?|op|method|command|cmd|mutation|query)\z"
)
DANGER_WORDS = ("submit", "pay", "confirm", "delete", "remove", "final")

# ---- fixed values: value formats, first match wins -------------------------
VALUE_FORMATS = (
    ("uuid", UUID),
    (
        "datetime",
        r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}[T ]\d{1,2}:\d{2}",
    ),
    ("date", r"^\d{4}-\d{2}-\d{2}\z|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\z"),
    ("numeric", r"^[+-]?(\d+|\d{1,3}(,\d{2,3})+)(\.\d+)?\z"),
    ("boolean", r"(?i)^(true|false|yes|no|y|n)\z"),
    ("url", r"(?i)^(https?:)?//\S+\z"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"),
)

# ---- fixed values: generated element ids and class names -------------------
GENERATED_ID_PREFIX = (
    r"(?i)^(mat-|cdk-|ng-|ember|react-|:r|radix-|headlessui-|downshift-|rc_|rc-|el-id-|v-|__)"
)
ID_COUNTER = r"[-_:.]\d+\z"
ID_HASH = r"(?i)^(?:[0-9a-f]{16,}|[a-z0-9]{24,})\z"
UNSTABLE_CLASS = (
    r"(?i)^(?:ng-|mat-|cdk-|css-|sc-|jss\d|Mui.*-\d|svelte-|is-|has-|js-)"
    r"|(?:active|selected|focus|hover|open|show|hidden|disabled|touched|dirty|pristine|valid|invalid|expanded|collapsed)\z"
    r"|[0-9a-f]{5,}|\d{3,}|__[A-Za-z0-9]{4,}\z"
)
TEST_ID_ATTRIBUTES = ("data-testid", "data-test", "data-cy", "data-qa", "data-test-id", "data-automation-id")

# ---- fixed values: ranks (order matters) -----------------------------------
LABEL_SOURCE_RANK = ("for", "wrap", "aria-labelledby", "aria-label", "container", "sibling", "placeholder", "none")
STABILITY_RANK = ("stable", "likely", "fragile")
WEAK_LABEL_SOURCES = ("none", "sibling", "container", "placeholder")
