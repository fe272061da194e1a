"""Spans of regular expressions in whole texts with SQL functions alone.

``split`` gives the gaps between the matches and ``regexp_extract_all`` the matches;
their lengths in code points add up to positions. Running totals are taken in blocks
of BLOCK, so a text with very many matches costs little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
NONE = "cast(array() as array<struct<start: bigint, end: bigint, hit: string>>)"


def _totals(sizes: str) -> str:
    """SQL of the running totals before each entry of an array column of longs."""
    fold = ("aggregate({0}, named_struct('t', {1}, 'a', cast(array() as array<bigint>)), "
            "(acc, x) -> named_struct('t', acc.t + x, 'a', concat(acc.a, array(acc.t))), acc -> acc.a)")
    blocks = f"transform(sequence(0, size({sizes}) div {BLOCK}), b -> aggregate(slice({sizes}, b * {BLOCK} + 1, {BLOCK}), 0L, (x, y) -> x + y))"
    inner = fold.format(f"slice({sizes}, b * {BLOCK} + 1, {BLOCK})", "s")
    return f"flatten(transform({fold.format(blocks, '0L')}, (s, b) -> {inner}))"


def with_spans(df: DataFrame, name: str, pattern: str, text: str = "text", gaps: bool = False) -> DataFrame:
    """Adds array column ``name``: start, end and hit of each leftmost non-overlapping match.
    With ``gaps``, also ``name``_gaps: the texts between them."""
    g, h, s, t = (f"__{name}_{x}" for x in "ghst")
    sql = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"`{text}` rlike {sql}"
    df = (df.withColumn(g, F.expr(f"if({found}, split(`{text}`, {sql}, -1), null)"))
          .withColumn(h, F.expr(f"if({g} is not null, regexp_extract_all(`{text}`, {sql}, 0), null)"))
          .withColumn(s, F.expr(f"transform({h}, (x, i) -> cast(length({g}[i]) + length(x) as bigint))"))
          .withColumn(t, F.expr(f"if({s} is not null, {_totals(s)}, null)"))
          .withColumn(name, F.expr(f"coalesce(transform({h}, (x, i) -> named_struct('start', {t}[i] + length({g}[i]), "
                                   f"'end', {t}[i] + length({g}[i]) + length(x), 'hit', x)), {NONE})")))
    if gaps:
        df = df.withColumn(f"{name}_gaps", F.col(g))
    return df.drop(g, h, s, t)


def labelled(columns: list[tuple[str, str]]) -> Column:
    """Spans of (column, kind) pairs as one array of (start, rank, kind, end), by start, then kind as listed."""
    return F.sort_array(F.concat(*(F.expr(
        f"transform(`{c}`, s -> named_struct('start', s.start, 'rank', {k}, 'kind', '{kind}', 'end', s.end))")
        for k, (c, kind) in enumerate(columns))))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
