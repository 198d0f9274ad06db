"""Word lists, patterns and limits that results depend on."""

# --- fixed values ---

#: Column names that need quoting in a common warehouse dialect.
RESERVED_WORDS = frozenset(
    [
        "all", "and", "any", "array", "as", "asc", "assert_rows_modified", "at", "between", "by", "case", "cast",
        "collate", "contains", "create", "cross", "cube", "current", "default", "define", "desc", "distinct", "else",
        "end", "enum", "escape", "except", "exclude", "exists", "extract", "false", "fetch", "following", "for", "from",
        "full", "group", "grouping", "groups", "hash", "having", "if", "ignore", "in", "inner", "intersect", "interval",
        "into", "is", "join", "lateral", "left", "like", "limit", "lookup", "merge", "natural", "new", "no", "not",
        "null", "nulls", "of", "on", "or", "order", "outer", "over", "partition", "preceding", "proto", "qualify",
        "range", "recursive", "respect", "right", "rollup", "rows", "select", "set", "some", "struct", "tablesample",
        "then", "to", "treat", "true", "unbounded", "union", "unnest", "using", "when", "where", "window", "with",
        "within",
    ]
)

MISSING = ["NA", "N/A", "n/a", "#N/A", "null", "NULL", "None", "NONE", "nan", "NaN", "NAN", "<NA>", "#NA", "missing", "MISSING", "nil", "NIL"]
MISSING_EXTENDED = ["-", "--", "---", ".", "..", "...", "?", "??", "???"]
MISSING_CSV = ["", "NA", "N/A", "n/a", "null", "NULL", "None", "#N/A"]
EXCEL_ERRORS = ["#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#GETTING_DATA"]

CURRENCIES = ["$", "€", "£", "¥", "₹", "CHF", "kr", "zł"]

#: Names of columns that hold dates, and of those that don't whatever else they say.
DATE_NAMES = ["date", "time", "timestamp", "created", "updated", "modified", "born", "expired?", "due", "start", "end", "period", "day", "month", "year"]
NON_DATE_NAMES = ["^year$", "^month$", "^day$", "^fiscal.?year$", "count", "total", "sum", "qty", "quantity", "amount", "number", "num", "id$", "_id$", "unique", "transactions?", "customers?", "users?", "orders?", "items?", "units?", "price", "cost", "revenue", "sales", "score", "rating", "rank", "index", "age", "size", "length", "width", "height", "weight", "percent", "rate", "ratio"]

#: Date formats in the order in which they are tried: as Spark patterns, and as strptime patterns for SQL.
DATE_FORMATS = [
    ("yyyy-M-d", "%Y-%m-%d"),
    ("d/M/yyyy", "%d/%m/%Y"),
    ("M/d/yyyy", "%m/%d/%Y"),
    ("yyyy/M/d", "%Y/%m/%d"),
    ("d-M-yyyy", "%d-%m-%Y"),
    ("M-d-yyyy", "%m-%d-%Y"),
    ("d.M.yyyy", "%d.%m.%Y"),
    ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S"),
    ("d/M/yyyy H:m:s", "%d/%m/%Y %H:%M:%S"),
    ("M/d/yyyy H:m:s", "%m/%d/%Y %H:%M:%S"),
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S"),
    ("MMMM d, yyyy", "%B %d, %Y"),
    ("MMM d, yyyy", "%b %d, %Y"),
    ("d MMMM yyyy", "%d %B %Y"),
    ("d MMM yyyy", "%d %b %Y"),
]
EXCEL_EPOCH, SERIAL_LEAST, SERIAL_MOST = "1899-12-30", 1, 60000

#: Kinds of columns by their names, tried in this order: dates, identifiers, numbers.
KIND_TEMPORAL = "^(year|month|day|fiscal.?year)$"
KIND_DATES = ["date", "time", "timestamp", "when", "created", "modified", "updated", "due", "start", "end", "period", "born", "birth", "expir", "valid"]
KIND_TEXTS = ["^id$", "_id$", "id$", "number$", "code$", "ref$", "key$", "^sku$", "sku$", "zip", "postal", "^account.*code", "batch", "^tracking", "^invoice.*number", "^order.*number", "^customer.*id", "^employee.*id", "^product.*id", "phone", "fax", "ssn", "ein", "iban", "swift"]
KIND_NUMBERS = ["amount", "price", "cost", "revenue", "total", "sum", "value", "balance", "qty", "quantity", "count", "sales", "profit", "expense", "fee", "charge", "rate", "percent", "margin", "weight", "height", "width", "length", "size", "tax", "discount"]

#: Lines above a text table, lines above a grid's header, lines below a table, words of headers, marks of pivot tables.
CSV_METADATA = [r"printed\s*(date)?", r"report\s*(date|name|:)", r"generated\s*(on|at|:)?", r"exported", r"^date\s*:", r"^\w+\s*:\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"]
GRID_METADATA = [r"printed\s*(date|on|by)", r"page\s*[-:]?\s*\d+\s*(of|/)\s*\d+", r"generated\s*(on|by|at)", r"report\s*(date|name|title)", r"^(as\s+of|date|run\s+date)\s*:"]
FOOTERS = [r"\bprepared\s+by\b", r"\bnotes?\s*:", r"\bgenerated\s+(on|at|by)\b", r"\breport\s+generated\b", r"\bsource\s*:", r"\bdisclaimer\b", r"\bconfidential\b", r"\bvalues\s+subject\s+to\b"]
HEADER_WORDS = ["id", "name", "date", "time", "code", "type", "status", "number", "amount", "qty", "count", "total"]
HEADER_TOKEN = r"^(?:[a-z]|\d+[a-z])[a-z0-9_]*$"
PIVOT_MARKS = ["Row Labels", "Column Labels", "Grand Total", "Count of", "Sum of", "Average of"]

#: Locales by decimal and thousands separator; all others write 1,234.56.
LOCALES_DOT = [
    "de", "nl", "it", "es", "pt", "el", "tr", "id",
]
LOCALES_SPACE = [
    "fr", "sv", "nb", "nn", "fi", "pl", "cs", "sk", "hu", "ro", "bg", "hr", "sl", "sr", "da", "ru", "uk",
]
EUROPEAN_FORMATS = [r"#\.##0,", r"0,00", r"\[\$€"]

#: Magic numbers, and formats by extension.
ZIP_MAGIC, OLE_MAGIC, BIFF8_MAGIC = b"PK\x03\x04", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"\x09\x08"
EXTENSIONS = {".xlsx": "xlsx", ".xlsm": "xlsm", ".xlsb": "xlsb", ".xls": "xls", ".csv": "csv", ".tsv": "tsv", ".txt": "csv"}
DELIMITERS = [",", "\t", ";", "|"]
ENCODING_FALLBACKS = ["latin-1", "windows-1252", "iso-8859-1"]

#: Empty rows at the end of the scan from which a longer sheet's region isn't carried on to its last row.
SCAN_STREAK = 10
#: Limits: rows scanned for a region, for a header, looked ahead; footer rows and blank streak; empty rows that end a sheet.
SCAN_ROWS, HEADER_ROWS, LOOK_AHEAD, FOOTER_ROWS, FOOTER_STREAK, EMPTY_STOP = 10_000, 16, 3, 10, 3, 100
#: Samples: values that vote on numbers, on dates, on separators, on mixed types; rows and columns that vote on formulas and locale.
NUMBER_SAMPLE, DATE_SAMPLE, SEPARATOR_SAMPLE, TYPE_SAMPLE = 50, 20, 50, 1000
FORMULA_WINDOW, LOCALE_WINDOW, PIVOT_ROWS, CSV_PROBE, CSV_MOST_SKIPPED = (50, 10), (51, 21), 20, 15, 6

# --- end of fixed values ---

#: White space as Python sees it, spelled out so that every regex dialect reads the same.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def any_of(patterns: list[str]) -> str:
    """One case-insensitive pattern that finds what any of them finds."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)
