"""Scalar functions (F1–F15) as pure Column expressions.

All of them compile to built-in Catalyst expressions, so they stay inside
whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# A string Python's float() accepts (ASCII digits only; see README deviations).
_FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FLOAT_SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
_YEAR_MONTH = r"^[0-9]{4}-(1[0-2]|0[1-9]|[1-9])$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ustrip(x) -> Column:
    """Strip Unicode white space at both ends (Python ``str.strip``)."""
    return F.btrim(_c(x), F.lit(fixed.WHITESPACE))


def python_float(x) -> Column:
    """Text → DOUBLE the way Python ``float()`` reads it, else null."""
    s = ustrip(x)
    low = F.lower(s)
    special = (F.when(low.rlike(r"nan$"), F.lit(float("nan")))
               .when(low.startswith("-"), F.lit(float("-inf")))
               .otherwise(F.lit(float("inf"))))
    return (F.when(s.rlike(_FLOAT_TEXT), s.try_cast("double"))
            .when(s.rlike(_FLOAT_SPECIAL), special))


def clean_numeric(raw, tokens=None) -> Column:
    """strip; drop ``,`` and ``%``; placeholder tokens → null; Python float."""
    tokens = fixed.NULL_TOKENS if tokens is None else tokens
    s = F.regexp_replace(ustrip(raw), r"[,%]", "")
    return F.when(_c(raw).isNull() | s.isin(tokens), F.lit(None).cast("double")) \
            .otherwise(python_float(s))


def is_placeholder(raw, tokens=None) -> Column:
    """True when F1 folds the text to null because it is a placeholder token."""
    tokens = fixed.NULL_TOKENS if tokens is None else tokens
    s = F.regexp_replace(ustrip(raw), r"[,%]", "")
    return _c(raw).isNotNull() & s.isin(tokens)


def is_numeric(raw, kind, number=None) -> Column:
    """would ``float(cell)`` succeed? Numbers and booleans yes, dates no,
    text only when Python reads it (no comma or percent removal). ``number``:
    ``python_float`` of the cell, where it is at hand."""
    k = _c(kind)
    return (F.when(_c(raw).isNull(), F.lit(False))
            .when(k.isin("n", "b"), F.lit(True))
            .when(k == "d", F.lit(False))
            .otherwise((python_float(raw) if number is None else number).isNotNull()))


def numeric_value(raw, kind, number=None) -> Column:
    """``float(cell)`` for cells where F2 holds (booleans are 1.0 / 0.0)."""
    k = _c(kind)
    return (F.when(k == "b", F.when(F.lower(_c(raw)) == "true", 1.0).otherwise(0.0))
            .when(k == "d", F.lit(None).cast("double"))
            .otherwise(python_float(raw) if number is None else number))


def month_from_text(text) -> Column:
    """first month, in calendar order, whose abbreviation occurs in the text."""
    t = F.lower(_c(text))
    out = F.lit(None).cast("int")
    for i, ab in reversed(list(enumerate(fixed.MONTH_ABBR, start=1))):
        out = F.when(t.contains(ab), F.lit(i)).otherwise(out)
    return out


def valid_year_month(d) -> Column:
    """``strptime(d, '%Y-%m')`` succeeds."""
    return F.coalesce(_c(d).rlike(_YEAR_MONTH), F.lit(False))


def _ym_parts(d) -> tuple[Column, Column]:
    """(year, month) integers of a valid ``YYYY-M[M]`` text; for use where it is known to be one."""
    return F.substring(_c(d), 1, 4).cast("int"), F.substring(_c(d), 6, 2).cast("int")


def _ym_text(y: Column, m: Column) -> Column:
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))


def month_start(d) -> Column:
    """First day of the month named by a valid ``YYYY-M[M]`` text, else null."""
    y, m = _ym_parts(d)
    return F.when(valid_year_month(d), F.make_date(y, m, F.lit(1)))


def current_month(d) -> Column:
    """normalised ``YYYY-MM`` of the request date (``2025-6`` → ``2025-06``)."""
    y, m = _ym_parts(d)
    return F.when(valid_year_month(d), _ym_text(y, m))


def previous_month(d) -> Column:
    """the month before the request date, ``YYYY-MM`` (integer arithmetic,
    no date parsing)."""
    y, m = _ym_parts(d)
    k = y * 12 + m - 2          # months since year 0 of the previous month, 0-based
    return F.when(valid_year_month(d), _ym_text(F.floor(k / 12).cast("int"), (k % 12 + 1).cast("int")))


def month_label_parts(ym) -> tuple[Column, Column]:
    """(three-letter lower-case month name, year text) of a ``YYYY-MM`` text."""
    m = F.substring(_c(ym), 6, 2).cast("int")
    abbr = F.element_at(F.array(*[F.lit(a) for a in fixed.MONTH_ABBR]), m)
    return abbr, F.substring(_c(ym), 1, 4)


def _digits_int(x) -> Column:
    return F.when(_c(x).rlike(r"^[0-9]+$"), _c(x).try_cast("int"))


# General period texts without "-", tried in this order: pattern (white space trimmed, lower
# case) and the groups that hold year, month and day (0: the first month or day). A month of
# letters must be a month word.
PERIOD_RULES = [
    (r"^([0-9]{4})$", 1, 0, 0),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3),
    (r"^([0-9]{4})[/.]([0-9]{1,2})$", 1, 2, 0),
    (r"^([0-9]{4})[/.]([0-9]{1,2})[/.]([0-9]{1,2})$", 1, 2, 3),
    (r"^([0-9]{1,2})/([0-9]{4})$", 2, 1, 0),
    (r"^(1[3-9]|2[0-9]|3[01])/([0-9]{1,2})/([0-9]{4})$", 3, 2, 1),      # no month is over 12
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 3, 1, 2),
    (r"^([a-z]+)[.]?,?\s*([0-9]{4})$", 2, 1, 0),
    (r"^([a-z]+)[.]?\s+([0-9]{1,2}),?\s+([0-9]{4})$", 3, 1, 2),
    (r"^([0-9]{1,2})\s+([a-z]+)[.]?,?\s+([0-9]{4})$", 3, 2, 1),
    (r"^([0-9]{4})\s+([a-z]+)[.]?$", 1, 2, 0),
    (r"^([0-9]{4})\s+([a-z]+)[.]?\s+([0-9]{1,2})$", 1, 2, 3),
]
# Quarters: the same, with a month for the quarter's number.
QUARTER_RULES = [(r"^([0-9]{4})q([1-4])$", 1, 2), (r"^([1-4])q([0-9]{4})$", 2, 1)]


def _period_date(s: Column) -> Column:
    """First day or date that a general period text names; null where it names none."""
    words = {str(i): i for i in range(1, 13)} | {f"{i:02d}": i for i in range(1, 13)} | fixed.MONTH_WORDS \
        | {f"q{q}": 3 * q - 2 for q in range(1, 5)}
    month = F.create_map(*[F.lit(x) for w, m in words.items() for x in (w, str(m))])

    def parts(t):       # year-month-day by the first rule that holds, the month as it is written
        rules = [(p, f"${y}-q${q}-1") for p, y, q in QUARTER_RULES]
        rules += [(p, f"${y}-{f'${m}' if m else 1}-{f'${d}' if d else 1}") for p, y, m, d in PERIOD_RULES]
        out = F
        for p, text in rules:
            out = out.when(t.rlike(p), F.regexp_replace(t, p, text))
        return F.split(out, "-")

    # A lambda names the text and its parts once: written out, the rules are too long to be compiled.
    ymd = F.transform(F.transform(F.array(F.lower(ustrip(s))), parts), lambda x: F.concat(
        x[0], F.lit("-"), F.try_element_at(month, x[1]), F.lit("-"), x[2]))
    found = F.try_to_timestamp(F.get(ymd, 0), F.lit("yyyy-M-d"))
    return F.when(F.year(found).between(1678, 2261), found)


def parse_period(raw, kind) -> Column:
    """struct(year, month) of a date cell.

    Text containing ``-`` is split and both leading parts must be all digits
    (no range check). Dates give their own year and month. Numbers are read as
    nanoseconds since the epoch (so ``202401`` is 1970-01). Other text goes
    through PERIOD_RULES; two-digit years, which depend on today, name no period.
    """
    s = _c(raw)
    k = _c(kind)
    parts = F.split(s, "-")
    dash_y = _digits_int(F.element_at(parts, 1))
    dash_m = _digits_int(F.element_at(parts, 2))
    ts_num = F.timestamp_seconds(F.floor(python_float(s) / F.lit(1e9)))
    iso = F.try_to_timestamp(s)
    ts = F.when(k == "n", ts_num).when(k == "d", iso).otherwise(_period_date(s))
    year = F.when(s.contains("-"), dash_y).otherwise(F.year(ts))
    month = F.when(s.contains("-"), dash_m).otherwise(F.month(ts))
    return F.struct(year.alias("year"), month.alias("month"))


def _month_word_map() -> Column:
    kv = []
    for w, m in fixed.MONTH_WORDS.items():
        kv += [F.lit(w), F.lit(f"{m:02d}")]
    return F.create_map(*kv)


def date_from_text(text, as_of) -> Column:
    """``YYYY-MM`` from link text: ``word yyyy``, then ``yyyy-mm``, then
    ``yyyymm`` (first match of each), else ``as_of``."""
    t = F.lower(_c(text))
    p1, p2, p3 = ("(?U)" + p for p in fixed.DATE_PATTERNS)
    w = F.regexp_extract(t, p1, 1)
    y1 = F.regexp_extract(t, p1, 2)
    m1 = F.element_at(_month_word_map(), w)
    d1 = F.when((y1 != "") & m1.isNotNull(), F.concat_ws("-", y1, m1))
    d2 = F.when(F.regexp_extract(t, p2, 0) != "",
                F.concat_ws("-", F.regexp_extract(t, p2, 1), F.regexp_extract(t, p2, 2)))
    d3 = F.when(F.regexp_extract(t, p3, 0) != "",
                F.concat_ws("-", F.regexp_extract(t, p3, 1), F.regexp_extract(t, p3, 2)))
    return F.coalesce(d1, d2, d3, _c(as_of))


def seasonal_flag(series) -> Column:
    """seasonally adjusted unless the series text contains ``NSA``
    (a null cell reads as ``None``, hence true)."""
    return ~F.upper(F.coalesce(_c(series), F.lit("None"))).contains("NSA")


def header_norm(x, strip: bool = False) -> Column:
    """F8: lower case, optional Unicode strip, newline → space."""
    t = F.lower(_c(x))
    if strip:
        t = ustrip(t)
    return F.regexp_replace(t, "\n", " ")


def series_label(ticker) -> Column:
    """default series id."""
    return F.concat(F.lit(fixed.SERIES_PREFIX), F.upper(_c(ticker)))


def _resolve_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a trailing ``.``/``..`` leaves a
    trailing slash. Returns the path with exactly one leading slash."""
    init = F.struct(F.array().cast("array<string>").alias("a"), F.lit("").alias("last"))

    def step(acc, seg):
        arr = acc["a"]
        nxt = (F.when(seg == "..", F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))))
               .when(seg == ".", arr)
               .otherwise(F.concat(arr, F.array(seg))))
        return F.struct(nxt.alias("a"), seg.alias("last"))

    def finish(acc):
        arr = F.when(acc["last"].isin(".", ".."), F.concat(acc["a"], F.array(F.lit(""))))\
               .otherwise(acc["a"])
        return F.concat(F.lit("/"), F.regexp_replace(F.array_join(arr, "/"), "^/", ""))

    return F.aggregate(F.split(path, "/"), init, step, finish)


def url_resolve(base, href) -> Column:
    """absolute URL of ``href`` against ``base`` (RFC 3986 style join).

    Scheme URLs and ``http…`` links are kept as they are; ``//host`` takes the
    base scheme; ``/path`` the base origin; other text is joined to the base
    directory (repeated slashes collapsed). ``.`` and ``..`` segments are
    resolved. The link's own query and fragment are kept.
    """
    b = _c(base)
    h = _c(href)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    b_dir = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*/)", 1)
    b_nofrag = F.regexp_extract(b, r"^([^#]*)", 1)
    b_noquery = F.regexp_extract(b, r"^([^?#]*)", 1)
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    path = F.when(h.startswith("/"), h_path).otherwise(
        F.regexp_replace(F.concat(b_dir, h_path), "/{2,}", "/"))
    joined = F.concat(origin, _resolve_path(path), h_rest)
    return (F.when(h.isNull(), F.lit(None).cast("string"))
            .when(h.startswith("http"), h)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h == "", b)
            .when(h.startswith("#"), F.concat(b_nofrag, h))
            .when(h.startswith("?"), F.concat(b_noquery, h))
            .when(h_path == "", F.concat(b_noquery, h_rest))
            .otherwise(joined))


def url_filename(url) -> Column:
    """last segment of the URL path (query and fragment dropped)."""
    u = _c(url)
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)
    return F.substring_index(path, "/", -1)


def four_digit_year(raw, lo: int = fixed.CONTEXT_YEAR_MIN,
                    hi: int = fixed.CONTEXT_YEAR_MAX) -> Column:
    """the cell text is exactly four ASCII digits within [lo, hi]; the year."""
    s = _c(raw)
    y = F.when(s.rlike(r"^[0-9]{4}$"), s.cast("int"))
    return F.when(y.between(lo, hi), y)


def link_priority(href, text) -> Column:
    """1 for ``cpi-u-YYYYMM.xlsx``, 2 for text exactly ``CPI-U``,
    3 for ``cpi…u`` anywhere; null when the link is no workbook or no match."""
    h = F.coalesce(_c(href), F.lit(""))
    t = F.coalesce(_c(text), F.lit(""))
    ci = "(?i)"
    workbook = h.rlike(ci + fixed.WORKBOOK_HREF)
    p1 = h.rlike(ci + fixed.PRIORITY1_PATTERN) | t.rlike(ci + fixed.PRIORITY1_PATTERN)
    p2 = ustrip(t).rlike(ci + fixed.PRIORITY2_TEXT)
    p3 = t.rlike(ci + fixed.PRIORITY3_PATTERN) | h.rlike(ci + fixed.PRIORITY3_PATTERN)
    return (F.when(~workbook, F.lit(None).cast("int"))
            .when(p1, F.lit(1)).when(p2, F.lit(2)).when(p3, F.lit(3)))


def category_list(s) -> Column:
    """split on commas, strip, drop blanks (no lambdas, so it stays in
    generated code: white space around commas is removed first, then the
    text is split on the bare commas)."""
    ws = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
    norm = F.regexp_replace(ustrip(s), f"{ws},{ws}", ",")   # pattern compiled once
    return F.array_remove(F.split(norm, ","), "")             # one-char split: fast path


def request_reject_reason(date, n_categories, max_categories: int | None) -> Column:
    """null for a valid request, else the reason it is rejected. ``max_categories``
    None: any number."""
    n = _c(n_categories)
    reason = (F.when(~valid_year_month(date), F.lit("date must be YYYY-MM"))
              .when(n < 1, F.lit("at least one category must be specified")))
    if max_categories is not None:
        reason = reason.when(n > max_categories, F.lit(f"maximum {max_categories} categories"))
    return reason


def period_label(year, month) -> Column:
    """``year-MM``."""
    return F.format_string("%d-%02d", _c(year), _c(month))
