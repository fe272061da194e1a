"""Anchors of stored HTML pages, extracted with Spark regex functions.

Only ``<a …>`` elements that carry an ``href`` attribute are kept, outside
comments, scripts and styles; the link text is the element's text with tags
removed, each text piece stripped and the pieces joined (as an HTML tree's
stripped text would be). Numbered and the common named entities are decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Comments, scripts and styles hold no elements.
HIDDEN = r"(?is)<!--.*?(?:-->|$)|<(script|style)(?=[\s>]).*?(?:</\1\s*>|$)"
# An anchor ends at its end tag, the next anchor, or the end of the text.
ANCHOR = r"(?is)<a(?=[\s>])[^>]*>(?:(?!<a(?=[\s>])|</a\s*>).)*+"
# --- fixed values: named entities, in the order applied; &amp; comes last ---
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
            ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&ndash;", "\u2013"), ("&mdash;", "\u2014"),
            ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"),
            ("&hellip;", "\u2026"), ("&eacute;", "\u00e9"), ("&euro;", "\u20ac")]
NUMBERED = r"&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));?"


def _numbered(x: Column) -> Column:
    """Numbered entities as their characters: the gaps between them and the characters in turn."""
    def char(h):
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(h, NUMBERED, 2), F.lit("")), 16, 10),
                          F.regexp_extract(h, NUMBERED, 1)).try_cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        one = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(h.isNull(), "").when(code == 38, "&amp;").when(valid, one).otherwise("\ufffd")     # & waits for its turn

    gaps = F.split(x, NUMBERED, -1)
    hits = F.regexp_extract_all(x, F.lit(f"({NUMBERED})"), F.lit(1))
    parts = F.transform(gaps, lambda g, i: F.concat(g, char(F.get(hits, i))))
    return F.when(x.contains("&#"), F.array_join(parts, "")).otherwise(x)


def decode_entities(x: Column) -> Column:
    x = _numbered(x)
    for k, v in ENTITIES:
        x = F.replace(x, F.lit(k), F.lit(v))
    return F.replace(x, F.lit("&amp;"), F.lit("&"))


def _href(tag: Column) -> Column:
    dq = F.regexp_extract(tag, r'(?is)(?:^|\s)href\s*=\s*"([^"]*)"', 1)
    sq = F.regexp_extract(tag, r"(?is)(?:^|\s)href\s*=\s*'([^']*)'", 1)
    uq = F.regexp_extract(tag, r"(?is)(?:^|\s)href\s*=\s*([^\s\"'>]+)", 1)
    return (F.when(tag.rlike(r'(?is)(^|\s)href\s*=\s*"'), dq)
            .when(tag.rlike(r"(?is)(^|\s)href\s*=\s*'"), sq)
            .when(tag.rlike(r"(?is)(^|\s)href\s*=\s*[^\s\"'>]"), uq)
            .when(tag.rlike(r"(?is)(^|\s)href(\s|=|$)"), F.lit("")))


def element_text(inner: Column) -> Column:
    parts = F.split(inner, "<[^>]*>")
    parts = F.transform(parts, lambda p: S.ustrip(decode_entities(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "")


def anchors(pages: DataFrame, base_col: str = "url") -> DataFrame:
    """``page_id, pos, base, href, text`` — one row per anchor with an href,
    ``pos`` = document order (from 0)."""
    a = pages.select("page_id", F.col(base_col).alias("base"),
                     F.posexplode(F.regexp_extract_all(F.regexp_replace("html", HIDDEN, ""), F.lit(ANCHOR), 0))
                     .alias("pos", "a"))
    tag = F.regexp_extract(F.col("a"), r"(?is)^<a(?=[\s>])([^>]*)>", 1)
    inner = F.regexp_extract(F.col("a"), r"(?is)^<a(?=[\s>])[^>]*>(.*)$", 1)
    href = _href(tag)
    return (a.select("page_id", "pos", "base", decode_entities(href).alias("href"),
                     element_text(inner).alias("text"))
            .filter(F.col("href").isNotNull()))
