"""Fixed values that decide results.  Change one and stored hashes, keys or views change."""

# Gist enums, in the order of the record definition.
CATEGORIES = (
    "billing",
    "accounts",
    "booking",
    "orders",
    "newsletter",
    "marketing",
    "personal",
    "institution",
    "other",
)
INTENTS = ("failure", "success", "reminder", "request", "reply", "warning", "info")

# Spellings a boolean field accepts besides JSON true/false.
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

CLUE_MAX_CHARS = 42
SENDER_MAX_CHARS = 40

# Classifier models and the suffix of structured cache rows.
MODEL_PRO = "gemini-3-pro-preview"
MODEL_FLASH = "gemini-3-flash-preview"
MODEL_FLASH_LITE = "gemini-3.1-flash-lite-preview"
GIST_SUFFIX = ":gist:v3"
MAX_ATTEMPTS = 3
RETRY_DELAY_SECONDS = 2.0

DOC_EXTENSIONS = (".pdf", ".xls", ".xlsx", ".ods")
UNSAFE_PATH_CHARS = '<>:"/\\|?*'
UNKNOWN_DOMAIN = "unknown.com"

CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥"}

SHORT_ID_MIN = 4
SHORT_ID_MAX = 52
SHORT_ID_FALLBACK = 7

UNDATED_WEEK = 9999

# RFC 2822 month names (both forms) and zone names, offsets in +-HHMM.
MONTHS_SHORT = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTHS_LONG = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)
ZONE_HHMM = {
    "UT": 0,
    "UTC": 0,
    "GMT": 0,
    "Z": 0,
    "AST": -400,
    "ADT": -300,
    "EST": -500,
    "EDT": -400,
    "CST": -600,
    "CDT": -500,
    "MST": -700,
    "MDT": -600,
    "PST": -800,
    "PDT": -700,
}

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
