"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least twice as long, that
neither neighbour extends. Every run is found:

*  Periods below ``BASE`` are read off directly: the words q apart that are equal. These are
   also the highly periodic regions that synchronising sets leave out.
*  For each dyadic scale t = 4, 8, ... the runs with 3t <= q < 6t are proposed by a
   t-synchronising set. Each position has the hash of its t words as name; positions where
   those have a period of at most t / 3 (found at smaller scales) have none. A position is
   chosen if the least name among it and the next t positions is its own or that of the last.
   Whether a position is chosen depends on its next 2t words (its context) alone, and unless
   the words are highly periodic, one of any t neighbours is chosen. So a run holds chosen
   positions with equal contexts q apart; all pairs with equal contexts and such a distance
   propose it. A context isn't highly periodic, so it recurs at most 18 times within 6t words.
*  What remains are runs uu where u is highly periodic, of period p, and doesn't go on so: here
   two runs of period p touch, and the distances at which their words agree are q0, q0 + p, ...
   up to their lengths. Each of these is proposed, and nearly each is a run.

A proposal is confirmed by comparing the words themselves, in doubling steps, both ways; of
equal stretches the one with the smallest period is the run. Hashes decide only which positions
are chosen, so a collision may cost time but no run.

Documents are independent: one pass, nothing is shuffled. Words of several documents are
numbered and searched together, with marks between them that equal nothing.

Defined results: a null text has no words, an empty one neither (no runs, the digest of
nothing); repeated rows each keep their row; of the longest runs the first, then the one with
the smaller period is reported; a document with a null doc_id keeps its words as they are.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import field_of, prepare, table

MIN_LENGTH = 12
BASE = 12              # periods below it are read off directly; 3 x the smallest scale
SCALE = 4
WORDS = 400_000        # words searched at a time (or one longer document)
_NO_NAME = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash below 2^63 of each number."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x >> np.uint64(1)


def _joined(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of twice ``size`` words from those of ``size``."""
    return _mix(h[:-size] * np.uint64(3) + h[size:]) if len(h) > size else h[:0]


class _Words:
    """Numbered words; comparisons in doubling steps."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.raw, self.n = ids, ids.tobytes(), len(ids)

    def _same(self, i: int, j: int, k: int) -> bool:
        return self.raw[4 * i:4 * (i + k)] == self.raw[4 * j:4 * (j + k)]

    def forward(self, i: int, j: int) -> int:
        """How many words from i equal those from j > i."""
        at, k = i, 4
        while j + k <= self.n and self._same(i, j, k):
            i, j, k = i + k, j + k, 2 * k
        while k > 1:
            k //= 2
            if j + k <= self.n and self._same(i, j, k):
                i, j = i + k, j + k
        return i - at

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j > i."""
        at, k = i, 4
        while k <= i and self._same(i - k, j - k, k):
            i, j, k = i - k, j - k, 2 * k
        while k > 1:
            k //= 2
            if k <= i and self._same(i - k, j - k, k):
                i, j = i - k, j - k
        return at - i

    def find(self, begin: int, size: int, low: int, high: int) -> int:
        """Where the words begin to begin + size first occur within low to high, or -1."""
        what, at = self.raw[4 * begin:4 * (begin + size)], 4 * low - 1
        while (at := self.raw.find(what, at + 1, 4 * high)) >= 0:
            if at % 4 == 0:
                return at // 4
        return -1


class _Runs:
    """Confirmed runs: their period by (begin, end)."""

    def __init__(self, words: _Words):
        self.words = words
        self.period: dict[tuple[int, int], int] = {}
        self.arrays = np.empty((0, 3), np.int64)

    def close(self):
        """Begin, end and period of all runs so far, for the next scale."""
        self.arrays = np.array([(b, e, p) for (b, e), p in self.period.items()], np.int64).reshape(-1, 3)

    def small(self):
        """Periods below BASE. Short runs of one or two words are kept for the scales that need them."""
        ids = self.words.ids
        for q in range(1, min(BASE, len(ids))):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-q] == ids[q:], [False]])))
            begin, end = edge[::2], edge[1::2] + q
            long = end - begin >= {1: SCALE, 2: 2 * SCALE}.get(q, max(MIN_LENGTH, 2 * q))
            for x in zip(begin[long].tolist(), end[long].tolist()):
                self.period.setdefault(x, q)
        self.close()

    def proposed(self, pairs: list[tuple[int, int]]):
        """Confirm proposals (period, position), smaller periods first."""
        last, done = 0, -1
        for q, s in sorted(pairs):
            if q == last and s < done:          # within the stretch just compared
                continue
            end = s + q + self.words.forward(s, s + q)
            begin = s - self.words.backward(s, s + q)
            last, done = q, end - q
            if end - begin >= 2 * q:
                self.period.setdefault((begin, end), q)
        self.close()

    def nameless(self, t: int, n: int) -> np.ndarray:
        """Which of n positions have t words with a period of at most t / 3."""
        b, e, p = self.arrays.T
        use = (3 * p <= t) & (e - b >= t) & (b < n)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, b[use], 1)
        np.add.at(change, np.minimum(e[use] - t + 1, n), -1)
        return np.cumsum(change[:-1]) > 0

    def touching(self, t: int) -> list[tuple[int, int]]:
        """Proposals from pairs of runs of one small period that touch."""
        b, e, p = self.arrays.T
        use = np.flatnonzero((3 * p <= t) & (e - b >= 3 * t))
        use = use[np.lexsort((b[use], p[use]))]
        out = []
        for x, y in zip(use[:-1], use[1:]):
            period = int(p[x])
            if p[y] != period or b[y] > e[x]:
                continue
            root = int(e[x]) - period
            at = self.words.find(root, period, int(b[y]), min(int(b[y]) + 2 * period - 1, int(e[y])))
            if at < 0:
                continue
            high = min(6 * t, int(min(e[x] - b[x], e[y] - b[y])) + 1)
            first = at - root
            first += -(-(3 * t - first) // period) * period
            out += [(q, root) for q in range(first, high, period)]
        return out


def _chosen(names: np.ndarray, t: int) -> np.ndarray:
    """Positions whose least name among them and the next t is their own or that of the last."""
    least, size = names, 1
    while size < t:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:-1], names[t:])
    first, last = names[:len(least)], names[t:]
    return np.flatnonzero((least != _NO_NAME) & ((first == least) | (last == least)))


def _pairs(at: np.ndarray, context: np.ndarray, t: int) -> list[tuple[int, int]]:
    """(distance, position) of chosen positions with equal contexts 3t to 6t apart."""
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    out, lag = [], 1
    while lag < len(at):
        apart = at[lag:] - at[:-lag]
        near = (context[lag:] == context[:-lag]) & (apart < 6 * t)
        if not near.any():
            break
        use = near & (apart >= 3 * t)
        out += zip(apart[use].tolist(), at[:-lag][use].tolist())
        lag += 1
    return out


def runs_of(documents: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each document, given as numbers (0 or more) of its words."""
    if min_length < MIN_LENGTH:
        raise ValueError(f"runs of fewer than {MIN_LENGTH} words aren't looked for")
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    order = [i for i in order if len(documents[i]) >= min_length]
    if not order:
        return out
    # Longest first, with a number of its own before each and at the end: larger scales need a beginning only.
    ids = np.concatenate([x for k, i in enumerate(order) for x in ([-1 - k], documents[i])] + [[-1 - len(order)]])
    words = _Words(ids.astype(np.int32))
    sizes = np.array([len(documents[i]) for i in order], np.int64)
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    found = _Runs(words)
    found.small()
    t, names = SCALE, _mix(words.ids.astype(np.int64).view(np.uint64) + np.uint64(1 << 40))
    for size in (1, 2):
        names = _joined(names, size)
    while (count := int((sizes >= 6 * t).sum())):
        limit = int(begins[count - 1] + sizes[count - 1]) + 1
        names = names[:max(limit - t + 1, 0)]
        context = _joined(names, t)
        hidden = found.nameless(t, len(names))
        at = _chosen(np.where(hidden, _NO_NAME, names) if hidden.any() else names, t)
        at = at[at < len(context)]
        found.proposed(_pairs(at, context[at], t) + found.touching(t))
        t, names = 2 * t, context
    for (b, e), q in found.period.items():
        if e - b >= max(min_length, 2 * q):
            k = int(np.searchsorted(begins, b, "right")) - 1
            out[order[k]].append((b - int(begins[k]), e - b, q))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def repeated(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where and with which period the registered query lets a document of n words repeat itself."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def _words(doc_id, text: str | None, edit) -> list[bytes]:
    words = (text or "").encode().split()
    if edit and (at := edit(doc_id, len(words))):
        a, p = at
        words[a:] = [words[a + i % p] for i in range(len(words) - a)]
    return words


def _numbered(documents: list[list[bytes]]) -> list[np.ndarray]:
    number = defaultdict()
    number.default_factory = number.__len__
    return [np.fromiter(map(number.__getitem__, x), np.int32, len(x)) for x in documents]


def _collapsed(words: list[bytes], runs) -> bytes:
    """The words without those that a run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic(docs: DataFrame, min_length: int = MIN_LENGTH, edit=None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): runs, by start and period, and the text without
    their repetitions (words joined by one space). ``edit``: (doc_id, words) -> (a, p) or None; from
    word a on, a text repeats its p words from there."""
    def group(ids, texts):
        words = [_words(i, t, edit) for i, t in zip(ids, texts)]
        return [(runs, _collapsed(w, runs)) for w, runs in zip(words, runs_of(_numbered(words), min_length))]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found, begin, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "") // 6
                if size >= WORDS or k + 1 == len(texts):
                    found += group(ids[begin:k + 1], texts[begin:k + 1])
                    begin, size = k + 1, 0
            counts = np.array([len(r) for r, _ in found], np.int64)
            flat = np.array([x for r, _ in found for x in r], np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), runs, pa.array([c for _, c in found], pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{field_of(docs, 'doc_id')}, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
             "collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Of ``periodic``'s rows: the number of runs, the longest one, and digests of runs and text."""
    # The greatest of these is the longest run, of several the first, then the one with the smaller period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("less"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.less")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic(table(spark, sf_dir, "documents"), edit=repeated))
