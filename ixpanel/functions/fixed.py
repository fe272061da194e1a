"""Fixed values.

These values must equal the ones the original service uses for results to
match; they are stated here plainly, in their natural order, in one place.
"""

# --- fixed values: month abbreviations, calendar order (month test = substring) ---
MONTH_ABBR = ["jan", "feb", "mar", "apr", "may", "jun",
              "jul", "aug", "sep", "oct", "nov", "dec"]

# --- fixed values: month words recognised in link text, with their month ---
MONTH_WORDS = {
    "january": 1, "jan": 1,
    "february": 2, "feb": 2,
    "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "may": 5,
    "june": 6, "jun": 6,
    "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sep": 9, "sept": 9,
    "october": 10, "oct": 10,
    "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}

# --- fixed values: placeholder tokens folded to null by the numeric cleaner ---
NULL_TOKENS = ["", "-", "N/A", "n/a", "nan"]

# --- fixed values: text read as missing when a first sheet is loaded
# (the default missing-value strings of the pandas spreadsheet reader) ---
SHEET_NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
                    "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
                    "NaN", "None", "n/a", "nan", "null"]

# --- fixed values: characters Python's str.strip() removes (Unicode white space) ---
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
              "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# --- fixed values: header texts of the supplemental index table ---
CATEGORY_HEADER = "expenditure category"
NSA_HEADER = "unadjusted indexes"
SA_HEADER = "seasonally adjusted indexes"
DATA_START_ROW = 6          # first data row of the supplemental table
HEADER_SEARCH_LAST_ROW = 10  # header rows 0..10 are searched (inclusive)
CATALOGUE_COLUMN = 1         # category catalogue reads this column

# --- fixed values: role words of the time-series layout, tried in this order ---
DATE_WORDS = ["date", "period", "time"]
VALUE_WORDS = ["value", "index", "cpi"]
SERIES_WORDS = ["series", "id", "code"]
SERIES_HEADER_ROWS = 10      # rows 0..9 are searched for the header
CONTEXT_MONTH_ROWS = 5       # rows 0..4 give a column its month
CONTEXT_YEAR_MIN = 2020
CONTEXT_YEAR_MAX = 2030

# --- fixed values: constants stamped on extracted points ---
POINT_CATEGORY = "Consumer Price Index (CPI-U)"
POINT_SOURCE = "bls_excel"
SERIES_PREFIX = "CPI_U_"

# --- fixed values: link patterns (all case-insensitive) ---
WORKBOOK_HREF = r"\.xlsx?$"
PRIORITY1_PATTERN = r"cpi-u-\d{6}\.xlsx$"
PRIORITY2_TEXT = r"^CPI-U$"
PRIORITY3_PATTERN = r"cpi.*u"
DATE_PATTERNS = [r"(\w+)\s+(\d{4})", r"(\d{4})-(\d{2})", r"(\d{4})(\d{2})"]

# --- fixed values: request limits and service defaults ---
MAX_CATEGORIES_POST = 200
MAX_CATEGORIES_GET = 20
STATUS_SAMPLE = 10
RECENT_PERIODS = 2
RETENTION_DAYS = 30
WORKBOOK_GLOB = "*.xlsx"

# --- fixed values: response messages ---
MSG_OK = "Successfully loaded data for {n} categories{suffix}"
MSG_OK_LONG_SUFFIX = "in long format"
MSG_EMPTY = "No data found for the specified categories and date {date}"
