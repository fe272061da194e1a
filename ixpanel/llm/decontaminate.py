"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the benchmark's windows: 10 consecutive words of an item, or
the whole of a shorter item. Symbols are words and a block is two adjacent
words. A shift table says how far the search may skip for the block that ends
at the current position: a block that ends no pattern prefix moves the search
by the pattern length less one, so most of a clean text is never looked at.
Where the shift is zero, the patterns that end with this block are taken from
its bucket, selected by the hash of their first two words, and compared word
by word. Patterns of each length have tables of their own, so one short item
doesn't shorten the skips of all others.

Patterns are held in blocks of at most ``max_windows`` windows, whatever the
size of the benchmark: each block is one pass over the documents that adds
its hits to those of the passes before.

Defined results: a null or empty text has no words (n_words 0, not
contaminated); an item without words is never found; items with equal texts
are all found; repeated rows each keep their row; an empty benchmark finds
nothing; item numbers are sorted and joined as strings, null ones left out. Items with a
null number are searched on request only; the query and the pipeline do.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, field_of, prepare, table

WINDOW = 10
MAX_WINDOWS = 200_000
# Bytes of words: digits, letters (lower-cased) and everything outside ASCII; all else is a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Searcher:
    """Wu-Manber tables for windows [(words, items)]."""

    def __init__(self, windows):
        self.number: dict[bytes, int] = {}
        by_length = defaultdict(lambda: defaultdict(set))
        for words, items in windows:
            key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            by_length[len(key)][key].update(items)
        self.base = len(self.number) + 1
        self.tables = [self._tables(m, found) for m, found in sorted(by_length.items())]

    def _tables(self, m: int, found: dict):
        b = min(2, m)
        shift: dict[int, int] = {}
        bucket = defaultdict(lambda: defaultdict(list))
        for key, items in found.items():
            for end in range(b, m + 1):
                block = self._block(key[end - b:end])
                shift[block] = min(shift.get(block, m), m - end)
            bucket[self._block(key[m - b:])][self._block(key[:b])].append((key, items))
        return m, b, shift, {k: dict(v) for k, v in bucket.items()}

    def _block(self, numbers) -> int:
        return numbers[0] * self.base + numbers[1] if len(numbers) == 2 else numbers[0]

    def search(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Hit ranges [begin, end) in words, and the items found."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        n, base = len(ids), self.base
        ranges, items = [], set()
        for m, b, shift, bucket in self.tables:
            skip = m - b + 1
            jump = shift.get
            pos = m - 1
            while pos < n:
                block = ids[pos - 1] * base + ids[pos] if b == 2 else ids[pos]
                s = jump(block, skip)
                if s:
                    pos += s
                    continue
                begin = pos - m + 1
                head = ids[begin] * base + ids[begin + 1] if b == 2 else ids[begin]
                for key, of in bucket[block].get(head, ()):
                    if tuple(ids[begin:pos + 1]) == key:
                        ranges.append((begin, pos + 1))
                        items |= of
                pos += 1
        return ranges, items


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def windows(benchmark: DataFrame, size: int = WINDOW, unnumbered: bool = False) -> DataFrame:
    """(window, items): distinct windows, words joined by spaces, with the item numbers as strings;
    unnumbered: those of items with a null number as well, whose number stays null."""
    words = F.filter(F.split(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                         "abcdefghijklmnopqrstuvwxyz"),
                             r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(
        ("" if unnumbered else "item is not null and ") + "size(words) > 0")
    cutout = item.select("item", "words", F.explode(F.sequence(
        F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("at"))
    return (cutout.select("item", F.array_join(F.slice("words", F.col("at"), size), " ").alias("window"))
            .groupBy("window").agg(F.collect_set(F.struct("item")).alias("items")).select("window", "items.item")
            .withColumnRenamed("item", "items"))


def _pass(bc):
    def run(batches):
        searcher = Searcher(bc.value)
        for batch in batches:
            n_words, hits, items = [], [], []
            for text, old_hits, old_items in zip(*(batch.column(k).to_pylist() for k in
                                                   ("text", "hits", "items"))):
                words = words_of(text)
                ranges, found = searcher.search(words)
                if old_hits:
                    ranges += [(h["begin"], h["end"]) for h in old_hits]
                n_words.append(len(words))
                hits.append([{"begin": a, "end": b} for a, b in _merged(ranges)])
                items.append(sorted(found.union(old_items or ()), key=lambda x: (x is None, x or "")))
            new = {"n_words": pa.array(n_words, pa.int64()),
                   "hits": pa.array(hits, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                   "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names],
                                             batch.schema.names)
    return run


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
         max_windows: int = MAX_WINDOWS, unnumbered: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, hits (ranges of word
    positions, merged, end exclusive), items (numbers of items with a window in the text;
    unnumbered: items with a null number are searched, too, and give one null at the end)."""
    spark = docs.sparkSession
    prepare(spark)
    head = f"{field_of(docs, 'doc_id')}, "
    tail = "n_words long, hits array<struct<begin: long, end: long>>, items array<string>"
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<begin: long, end: long>>)").alias("hits"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    for last, bc in _blocks(spark, benchmark, size, max_windows, unnumbered):
        out = out.mapInArrow(_last(bc) if last else _pass(bc), head + ("" if last else "text binary, ") + tail)
        if not last:
            out = cut(out)          # one block of patterns in a worker at a time
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, size: int, max_windows: int, unnumbered: bool):
    """The windows in blocks of at most ``max_windows``, each broadcast: that bounds what the driver and
    a worker hold, not the benchmark's size."""
    every = cut(windows(benchmark, size, unnumbered))
    blocks = max(1, -(-every.count() // max_windows))
    every = every.withColumn("block", F.expr(f"pmod(xxhash64(window), {blocks})"))
    for block in range(blocks):
        yield block == blocks - 1, spark.sparkContext.broadcast(
            [(tuple(r.window.encode().split(b" ")), tuple(r["items"]))
             for r in every.where(F.col("block") == block).toLocalIterator()])


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) without a window of any item, numbered or not:
    for each block of windows one pass that carries the whole rows."""
    def searched(bc, at=docs.columns.index("text")):
        def run(batches):
            searcher = Searcher(bc.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not searcher.search(words_of(t and t.encode()))[0] for t in texts], pa.bool_()))
        return run

    prepare(docs.sparkSession)
    out = docs
    for last, bc in _blocks(docs.sparkSession, benchmark, size, max_windows, True):
        out = out.mapInArrow(searched(bc), docs.schema)
        if not last:
            out = cut(out)          # one block of patterns in a worker at a time
    return out


def _last(bc):
    step = _pass(bc)

    def run(batches):
        for b in step(batches):
            yield b.drop_columns(["text"])
    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnumbered=True)
    n_hit = F.expr("aggregate(hits, 0L, (n, h) -> n + h.end - h.begin)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH lowered AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[p:p + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM wins),
grams AS (
  SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM lowered, lens)),
found AS (SELECT doc_id, item_id, p, g.m AS m FROM grams g JOIN wins USING (w) WHERE g.m = wins.m),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM
  (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
