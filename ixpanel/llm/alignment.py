"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by two tokenizers, A and B. The tokens' bytes add up to the same string, so
both are arrays of ends, and offsets where both have one cut the tokens into groups. Most groups
are one to one and come in stretches, where the index of B is that of A plus a constant shift:
the search compares the two arrays of ends at the current shift, doubling the stretch as long as
they agree and halving it where they don't, and so jumps to the end of the stretch. There it
steps through the smaller ends until both agree again, which closes an irregular group and gives
the new shift.

All texts of a batch are aligned in one go, end to end: a text's end is a common one.

Links are the pairs of A and B tokens of one group. How many documents hold an (A id, B id) pair
is counted over the whole corpus. A document's distinct pairs are kept with their multiplicities;
documents are dealt to chunks of bounded size as they are encoded. Counts of pairs come from
grouped sums; each chunk's own distinct pairs, far fewer than those of its documents, take their
counts by a join, and go back to the chunk. So a pair that every document holds is one row a
chunk, and nothing is broadcast.

A is byte-level BPE whose merges are in order of the ids (checked), B a SentencePiece model with
byte fallback. Each worker reads the files from the paths given, which must be there on every
machine; nothing of them is copied.

Defined results: a null or empty text, and one whose A or B tokens don't give back a space and the
text, has no tokens (zeros and an empty string); special tokens' strings are text; a pair linked
several times in a document counts once for it; repeated rows are documents of their own.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ixpanel.llm.common import cut, field_of, prepare, table

BYTE_BPE = os.environ.get("BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
# How byte-level BPE splits a text first (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = 1 << 21          # characters of texts aligned in one go, or one longer text
CHUNK = 300_000          # distinct pairs of documents in a chunk, or those of one batch part
WIDE = 4096              # groups of more links are counted by distinct ids first


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: its own if it prints."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and their tokens' bytes by id."""

    def __init__(self, byte_bpe: str, pieces: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(byte_bpe, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_chars()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(map(byte.__contains__, t))}
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        ids = [model["vocab"][m.replace(" ", "")] for m in merged]
        if ids != sorted(ids) or len(ranks) != len(ids) + 256 or (ids and min(ids) < 256):
            raise ValueError("merges and ids of the byte-level vocabulary aren't in one order")
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.pair_type = pa.int32() if len(self.a_bytes) * len(self.b_bytes) < 2**31 else pa.int64()
        # What a group's tokens look like in writing: an id and what follows it.
        self.written = pa.array([f"{i}{c}" for table, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
                                 for i in range(len(table)) for c in marks], pa.string())

    def _piece(self, i: int) -> bytes:
        p = self._b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by A and by B; none where either doesn't give back a space and the text."""
        out = []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1)):
            a = self._a.encode_ordinary(" " + text) if text else []
            want = (" " + text).encode()
            if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
                a, b = [], []
            out.append((a, b))
        return out


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the numbers of A and B tokens up to its end. a, b: ends, with the same last one."""
    a, b = np.ascontiguousarray(a, np.int64), np.ascontiguousarray(b, np.int64)
    left, right, i, j, n = a.tobytes(), b.tobytes(), 0, 0, len(a)
    at_a, at_b = memoryview(left).cast("q"), memoryview(right).cast("q")
    begins, counts, shifts = [], [], []              # stretches of one-to-one groups; a group is one of its own
    while i < n:
        begin, k = i, 4
        while i + k <= n and left[8 * i:8 * (i + k)] == right[8 * j:8 * (j + k)]:
            i, j, k = i + k, j + k, 2 * k
        while k > 1:
            k //= 2
            if i + k <= n and left[8 * i:8 * (i + k)] == right[8 * j:8 * (j + k)]:
                i, j = i + k, j + k
        if i > begin:
            begins.append(begin + 1)
            counts.append(i - begin)
            shifts.append(j - i)
        if i == n:
            break
        x, y = at_a[i], at_b[j]
        while x != y:
            if x < y:
                i += 1
                x = at_a[i]
            else:
                j += 1
                y = at_b[j]
        i, j = i + 1, j + 1
        begins.append(i)
        counts.append(1)
        shifts.append(j - i)
    counts = np.array(counts, np.int64)
    step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = np.repeat(np.array(begins, np.int64), counts) + step
    return ends, ends + np.repeat(np.array(shifts, np.int64), counts)


class Aligned:
    """Texts of a batch part, aligned: counts, groups in writing, and distinct linked pairs."""

    def __init__(self, tokens: list[tuple[list[int], list[int]]], of: Tokenizers):
        n, self.n_b_ids = len(tokens), len(of.b_bytes)
        self.n_a, self.n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        a, b = (np.fromiter((x for t in tokens for x in t[k]), np.int64, int(m.sum()))
                for k, m in ((0, self.n_a), (1, self.n_b)))
        end_a, end_b = common_ends(np.cumsum(of.a_size[a]), np.cumsum(of.b_size[b]))
        size_a, size_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        doc = np.searchsorted(np.cumsum(self.n_a), end_a - 1, "right")
        self.n_groups = np.bincount(doc, minlength=n).astype(np.int64)
        self.n_links = np.bincount(doc, size_a * size_b, minlength=n).astype(np.int64)
        self.groups = self._written(a, b, end_a, end_b, size_a, size_b, of)
        self._pair(a, b, end_a, end_b, size_a, size_b, doc, n)

    def _written(self, a, b, end_a, end_b, size_a, size_b, of) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        code_a, code_b = 2 * a, 2 * (b + len(of.a_bytes))
        code_a[end_a - 1] += 1
        code_b[end_b - 1] += 1
        # A's tokens stand behind B's of all groups before, B's behind A's of their own group too.
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(end_b - size_b, size_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(end_a, size_b)] = code_b
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), of.written.take(pa.array(codes))), "")
        return pc.utf8_slice_codeunits(text, 0, -1)

    def _pair(self, a, b, end_a, end_b, size_a, size_b, doc, n):
        """Distinct pairs of each text (A id x number of B ids + B id) and how often they are linked."""
        links = size_a * size_b
        narrow = links <= WIDE
        la, lb, ld = ((x[narrow] for x in (end_a - size_a, end_b - size_b, doc)))
        per, nb = links[narrow], size_b[narrow]
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        i, j = np.divmod(k, np.repeat(nb, per))
        self.width = width = np.int64(self.n_b_ids) * np.int64(max(int(a.max(initial=0)) + 1, 1))
        keys = [np.repeat(ld, per) * width + a[np.repeat(la, per) + i] * self.n_b_ids + b[np.repeat(lb, per) + j]]
        keys, times = np.unique(keys[0], return_counts=True)
        for g in np.flatnonzero(~narrow):
            xs, xn = np.unique(a[end_a[g] - size_a[g]:end_a[g]], return_counts=True)
            ys, yn = np.unique(b[end_b[g] - size_b[g]:end_b[g]], return_counts=True)
            more = (doc[g] * width + xs[:, None] * self.n_b_ids + ys).ravel()
            keys, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, np.outer(xn, yn).ravel()])).astype(np.int64)
        self.starts = np.searchsorted(keys, np.arange(n + 1) * width)
        self.pairs, self.times = keys % width, times


_LOADED: dict = {}


def _tokenizers(byte_bpe: str, pieces: str) -> Tokenizers:
    if (byte_bpe, pieces) not in _LOADED:
        _LOADED.clear()
        _LOADED[byte_bpe, pieces] = Tokenizers(byte_bpe, pieces)
    return _LOADED[byte_bpe, pieces]


def _parts(texts: list[str]):
    """Slices of a batch of at most TEXTS characters (or one longer text)."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > TEXTS:
            yield begin, k
            begin, size = k, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def _small(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}") if n else np.empty(0, np.uint8)


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, chunk_pairs: int = CHUNK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): chunk, n_a, n_b, n_groups, n_links, groups (written
    as ``a1,a2|b1;a3|b2,b3``), and its distinct linked pairs (``pair_of`` has the ids) with how often each is."""
    def run(batches):
        of = _tokenizers(byte_bpe, pieces)
        kind = of.pair_type
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in _parts(texts):
                x = Aligned(of.encode(texts[begin:end]), of)
                if held and held + len(x.pairs) > chunk_pairs:
                    chunk, held = chunk + 1, 0
                held += len(x.pairs)
                pairs = pa.ListArray.from_arrays(pa.array(x.starts, pa.int32()), pa.array(x.pairs, kind))
                times = [_small(x.times[i:j]) for i, j in zip(x.starts, x.starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(np.full(end - begin, chunk)),
                     *(pa.array(c) for c in (x.n_a, x.n_b, x.n_groups, x.n_links)), x.groups,
                     pairs, pa.array(times, pa.binary())],
                    ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    prepare(docs.sparkSession)
    of = _tokenizers(byte_bpe, pieces)
    kind = of.pair_type
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{field_of(docs, 'doc_id')}, chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
             f"groups string, pairs array<{'int' if kind == pa.int32() else 'bigint'}>, times binary")


def pair_of(pair, n_b_ids: int):
    """A id and B id of a pair's number."""
    return F.floor(pair / n_b_ids).cast("int"), (pair % n_b_ids).cast("int")


def pair_counts(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """(in_chunk, pair, count, best): each chunk's pairs, how many documents of all hold them linked, and
    whether no other pair with this A id has more."""
    in_chunk = aligned.select("chunk", F.explode("pairs").alias("pair")).groupBy("chunk", "pair").agg(
        F.count("*").alias("n"))
    counts = in_chunk.groupBy("pair").agg(F.sum("n").alias("count"))
    # At most as many rows for an A id as B has ids.
    most = F.max("count").over(Window.partitionBy(pair_of(F.col("pair"), n_b_ids)[0]))
    counts = counts.withColumn("best", F.col("count") == most)
    return in_chunk.select(F.col("chunk").alias("in_chunk"), "pair").join(counts, "pair")


def with_counts(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """``aligned`` (a written table) without its pairs, but with n_best (links whose count is their A id's
    highest) and count_sum (of the counts of all links)."""
    rest = [c for c in aligned.columns if c not in ("pairs", "times", "chunk")]

    def chunk(rows: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("pair")
        pair, count, best = (counts[c].to_numpy() for c in ("pair", "count", "best"))
        rows = rows.combine_chunks()
        sums = np.zeros((2, len(rows)), np.int64)
        for k, (pairs, raw) in enumerate(zip(rows["pairs"], rows["times"])):
            at = np.searchsorted(pair, pairs.values.to_numpy())
            times = _counts(raw.as_py(), len(at)).astype(np.int64)
            sums[:, k] = times @ best[at].astype(np.int64), times @ count[at]
        return rows.select(rest).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    schema = ", ".join(field_of(aligned, c) for c in rest) + ", n_best bigint, count_sum bigint"
    return aligned.groupBy("chunk").cogroup(pair_counts(aligned, n_b_ids).groupBy("in_chunk")).applyInArrow(
        chunk, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"))
    digested = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    n_b_ids = len(_tokenizers(BYTE_BPE, PIECES).b_bytes)
    return with_counts(cut(aligned.select(*(c for c in aligned.columns if c != "groups"), digested)), n_b_ids)


def brute_pairs(groups: str) -> Counter:
    """Links of a text's written groups, one by one (for tests and small texts)."""
    out: Counter = Counter()
    for group in filter(None, groups.split(";")):
        a, b = (list(map(int, side.split(","))) for side in group.split("|"))
        out.update((x, y) for x in a for y in b)
    return out
