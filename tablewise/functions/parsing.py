"""Reading values out of messy strings, as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MISSING_TOKENS = (
    "", "na", "n/a", "null", "none", "-", "—", "?", "nan", "#n/a", "nil", "missing", "undefined", "#value!", "#div/0!",
)
CURRENCY_CODES = "AUD|USD|EUR|GBP|BDT|INR|NZD|CAD"
CURRENCY_SYMBOLS = "$€£¥₹৳"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
WHITE_SPACE = " \t\n\x0b\x0c\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
FIRST_YEAR, LAST_YEAR = 1000, 2999
CENTURY_PIVOT = 50
EXCEL_SERIAL_RANGE = (20000, 80000)
EXCEL_UNIX_OFFSET_DAYS = 25569
# ----------------------------------------------------------------------------


def squeeze_ends(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def is_missing_token(c: Column) -> Column:
    """True for null and for the spellings of "nothing here"."""
    text = F.lower(squeeze_ends(c.cast("string")))
    return c.isNull() | text.isin(*MISSING_TOKENS)


def present(c: Column) -> Column:
    """Trimmed string, or null when the value is a missing token."""
    return F.when(~is_missing_token(c), squeeze_ends(c.cast("string")))


_BRACKET = "\u0001"  # stands for a pair of brackets until the digits are known


def parse_number(c: Column, decimal_comma: bool = False) -> Column:
    """Number in a string with currency, percent sign, brackets for negatives and grouped digits; null if unreadable.

    One chain of string rewrites with a single cast at the end, so no step is evaluated twice.
    """
    t = F.regexp_replace(squeeze_ends(c.cast("string")), r"^\((.*)\)$", _BRACKET + "$1")
    t = F.regexp_replace(t, rf"(?iU)^({_BRACKET}?)(?:{CURRENCY_CODES})\s*", "$1")
    t = F.regexp_replace(t, rf"(?iU)\s*(?:{CURRENCY_CODES})$", "")
    t = F.regexp_replace(t, rf"^({_BRACKET}?)(?:(-)|\+)?[{CURRENCY_SYMBOLS}]", "$1$2")
    t = F.regexp_replace(t, rf"[{CURRENCY_SYMBOLS}]$", "")
    t = F.regexp_replace(t, "%$", "")
    t = F.regexp_replace(t, r"(?U)\s", "")
    # A separator goes only when the whole text is grouped in threes; the literal first keeps the search cheap.
    grouped = lambda sep, tail: (
        rf"{sep}(?<=^{_BRACKET}?[-+]?\d{{1,3}}(?:{sep}\d{{3}}){{0,99}}{sep})(?=\d{{3}}(?:{sep}\d{{3}})*(?:{tail}\d+)?$)"
    )
    if decimal_comma:
        t = F.regexp_replace(t, grouped(r"\.", ","), "")
        t = F.regexp_replace(t, rf"^({_BRACKET}?[-+]?\d*),(\d+)$", "$1.$2")
    else:
        t = F.regexp_replace(t, grouped(",", r"\."), "")
    t = F.regexp_replace(t, _BRACKET + "-", "")
    t = F.regexp_replace(t, _BRACKET + r"\+?", "-")
    digits = F.regexp_extract_all(t, F.lit(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), F.lit(0))
    v = F.get(digits, F.lit(0)).cast("double")  # unreadable text is null before the cast, which would throw per row
    return F.when(F.abs(v) != float("inf"), v)


# --- fixed values: the date shapes -------------------------------------------
_CLOCK = r"(?:[ T,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*(AM|PM|am|pm)?)?"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK + "$"
_NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2}|\d{4})" + _CLOCK + "$"
_DAY_MONTH_NAME = r"^(\d{1,2})[\s-]+([A-Za-z]{3,9})\.?[\s\-,]+(\d{4})" + _CLOCK + "$"
_MONTH_NAME_DAY = r"^(?:[A-Za-z]{3,9},?\s+)?([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _CLOCK + "$"
_MONTH_YEAR = r"^([A-Za-z]{3,9})\.?[\s-]+(\d{4})$"
_YEAR_MONTH = r"^(\d{4})-(\d{1,2})$"
_YEAR_QUARTER = r"^(\d{4})\s*-?\s*[qQ]([1-4])$"


# ----------------------------------------------------------------------------
_SHAPES = (
    # (pattern, rewrite to "layout|year|month|day|hour|minute|second|half")
    (_ISO, "y|$1|$2|$3|$4|$5|$6|$7"),
    (_NUMERIC, "n|$3|$1|$2|$4|$5|$6|$7"),
    (_DAY_MONTH_NAME, "y|$3|$2|$1|$4|$5|$6|$7"),
    (_MONTH_NAME_DAY, "y|$3|$1|$2|$4|$5|$6|$7"),
    (_MONTH_YEAR, "y|$2|$1|1||||"),
    (_YEAR_MONTH, "y|$1|$2|1||||"),
    (_YEAR_QUARTER, "q|$1|$2|1||||"),
)


def _moment(parts: Column, order: str) -> Column:
    """Timestamp from the seven text parts, or null when they name no real moment."""
    # Only digits are cast: a failing cast costs an exception per row.
    whole = lambda i: F.when(parts[i].rlike(r"^\d+$"), parts[i].cast("int"))
    layout, year, m, d = parts[0], whole(1), whole(2), whole(3)
    named = F.array_position(F.array(*[F.lit(x.lower()) for x in MONTHS]), F.lower(F.substring(parts[2], 1, 3))).cast("int")
    swapped = (m > 12) | ((d <= 12) & F.lit(order != "mdy"))  # numeric dates arrive as first|second part
    month = (
        F.when(layout == "q", m * 3 - 2)
        .when((layout == "n") & swapped, d)
        .otherwise(F.coalesce(m, named))
    )
    day = F.when((layout == "n") & swapped, m).otherwise(d)
    full_year = F.when(F.length(parts[1]) > 2, year).when(year < CENTURY_PIVOT, year + 2000).otherwise(year + 1900)
    h, half = F.coalesce(whole(4), F.lit(0)), F.lower(parts[7])
    hour = F.when((half == "pm") & (h < 12), h + 12).when((half == "am") & (h == 12), 0).otherwise(h)
    made = F.try_make_timestamp_ntz(full_year, month, day, hour, F.coalesce(whole(5), F.lit(0)),
                                    F.coalesce(whole(6), F.lit(0)).cast("decimal(16,6)"))
    return F.when(full_year.between(FIRST_YEAR, LAST_YEAR), made)


def parse_date(c: Column, order: str = "dmy") -> Column:
    """Timestamp from the seven supported date shapes; null when none fits or the day does not exist."""
    raw = squeeze_ends(c.cast("string"))
    t = F.regexp_replace(raw, r"(?i)\s*(GMT|UTC)\s*[+-]?\d{0,2}(:?\d{2})?$", "")
    t = F.regexp_replace(t, "Z$", "")
    t = F.regexp_replace(t, r"^(.*\dT\d.*)[+-]\d{2}:?\d{2}$", "$1")
    # Every shape rewrites to one layout; a text that fits none keeps no bars and yields null.
    for pattern, layout in _SHAPES:
        t = F.regexp_replace(t, pattern, layout)
    # One-element transform: the split parts are computed once and shared by every use below.
    return F.transform(F.array(F.split(t, r"\|")), lambda p: F.when(F.size(p) == 8, _moment(p, order)))[0]


def excel_serial_date(v: Column) -> Column:
    """Spreadsheet day serials (20000 < v < 80000) as timestamps."""
    low, high = EXCEL_SERIAL_RANGE
    seconds = (v.cast("double") - EXCEL_UNIX_OFFSET_DAYS) * 86400
    return F.when((v > low) & (v < high), F.timestamp_seconds(seconds).cast("timestamp_ntz"))


def date_order_votes(c: Column) -> tuple[Column, Column]:
    """Flags: the first part can only be a day, the second part can only be a day."""
    shape = r"^(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}"
    t = squeeze_ends(c.cast("string"))
    first = F.nullif(F.regexp_extract(t, shape, 1), F.lit("")).try_cast("int")
    second = F.nullif(F.regexp_extract(t, shape, 2), F.lit("")).try_cast("int")
    return F.coalesce(first > 12, F.lit(False)), F.coalesce(second > 12, F.lit(False))


def currency_symbol(c: Column) -> Column:
    """The currency symbol at the front (after a sign or bracket) or at the end; null if none."""
    t = squeeze_ends(c.cast("string"))
    hits = F.regexp_extract_all(t, F.lit(rf"^[-(]?[{CURRENCY_SYMBOLS}]|[{CURRENCY_SYMBOLS}]\)?$"), F.lit(0))
    return F.regexp_extract(F.get(hits, F.lit(0)), rf"[{CURRENCY_SYMBOLS}]", 0)


def js_round(c: Column, digits: int = 0) -> Column:
    """Round half up towards plus infinity."""
    scale = 10 ** digits
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)) / F.lit(float(scale))


def number_text(c: Column) -> Column:
    """Shortest text of a number: whole numbers carry no decimal point."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
