"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has bit b set if more than half of the document's shingle
hashes have it. All distinct fingerprints are compared exactly with numpy
exclusive-or and bit counts, tile against tile. A tile holds fingerprints
whose four 16-bit quarters have the same population counts; the distance of
two fingerprints is at least the sum of the differences of those counts, so
tile pairs that differ by more than the radius are skipped without a loss.
Tiles of a crowded cell are split by a hash, so none grows with the input.

Defined results: a null or empty text has no words and fingerprint zero, and
links like any other; fewer words than a shingle hash as one; repeated rows
each keep their row; rows with a null doc_id take part, but never give the
component its number (null only if no member has a number).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, field_of, prepare, table
from ixpanel.llm.components import connected_components, star_forest

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096            # fingerprints of one tile, on average at most
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of one UTF-8 text as an unsigned number."""
    words = (text or b"").translate(_LOWER).split()   # bytes split at 20 and 09-0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        digests = [xxhash.xxh64_digest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        begin = end - size
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], SEED) for a, b in
                   zip(begin[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(digests), 32768):
        block = np.frombuffer(b"".join(digests[k:k + 32768]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"{field_of(docs, 'doc_id')}, fp long")


def _close(a: np.ndarray, b: np.ndarray, radius: int, step: int = 512):
    """Index pairs of two arrays at ``radius`` bits or fewer."""
    i, j = [], []
    for k in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[k:k + step, None] ^ b[None, :]) <= radius)
        i.append(x + k)
        j.append(y)
    return np.concatenate(i), np.concatenate(j)


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            left, right = [], []
            for a, b in zip(batch.column(0), batch.column(1)):
                a = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                i, j = _close(a, b, radius)
                leaf, root = star_forest(len(a) + len(b), i, j + len(a))
                both = np.concatenate([a, b]).view(np.int64)
                left.append(both[leaf])
                right.append(both[root])
            if left:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fps`` (fp): distinct fingerprints. Returns links (a, b) that connect exactly those
    fingerprints which chains of distances up to ``radius`` connect: every tile pair gives
    a star forest of its links instead of all of them."""
    cell = ["q0", "q1", "q2", "q3"]
    fps = fps.select("fp", *(F.expr(f"bit_count(shiftrightunsigned(fp, {16 * k}) & 65535)").alias(q)
                             for k, q in enumerate(cell)))
    # At most 17^4 = 83,521 rows whatever the input, so it may be broadcast.
    cells = cut(fps.groupBy(*cell).count()
                .select(*cell, F.ceil(F.col("count") / tile).cast("int").alias("n")))
    tiles = cut(fps.join(F.broadcast(cells), cell)
                .withColumn("part", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
                .groupBy(*cell, "part").agg(F.collect_list("fp").alias("fps")))
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4)
             if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0)]      # half of them, and itself
    near = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(s))) for s in steps))
    other = [F.col(f"t{k}").alias(q) for k, q in enumerate(cell)]
    pairs = (tiles.withColumn("s", F.explode(near))
             .select(F.col("fps").alias("a"), F.col("part").alias("part_a"),
                     F.expr("s = named_struct('d0', 0, 'd1', 0, 'd2', 0, 'd3', 0)").alias("own"),
                     *((F.col(q) + F.col(f"s.d{k}")).alias(f"t{k}") for k, q in enumerate(cell)))
             .select("a", "part_a", "own", *other)
             .join(F.broadcast(cells), cell)
             .withColumn("part", F.explode(F.sequence(F.when(F.col("own"), F.col("part_a")).otherwise(0),
                                                      F.col("n") - 1)))
             .drop("n", "part_a", "own"))
    both = pairs.join(tiles.withColumnRenamed("fps", "b"), [*cell, "part"]).select("a", "b")
    return both.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    fps = cut(fingerprints(docs, shingle))
    by_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(links(fps.select("fp").distinct(), radius, tile))
    grouped = by_fp.join(roots, by_fp.fp == roots.id, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    grouped = cut(grouped)
    first = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(grouped.join(cut(first), "root").select("fp", "component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
