"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

A text becomes pieces of a given vocabulary with byte fallback; a segmentation's
score is the sum of its pieces' scores. Forward Viterbi gives the best score from
the start of a lattice to each position; these scores are exact heuristics for an
A* search that runs backward from the end and yields segmentations best first.

No piece of the vocabulary has a word mark after another character, and the
characters fall into classes (scripts, punctuation) that no piece mixes. So every
path through a document's lattice passes through the cuts before word marks and
between classes, and the lattice is a chain of small ones. Viterbi scores of each
distinct small one, forward and backward, are found once per worker; they also
give what the cheapest deviation from its best path costs. The N best of the
document deviate only at the N - 1 places where that is least, so only those
lattices are searched for more, and the document's N best are merged from there.

Decoding gives the text back exactly, whatever it holds: characters without a
piece, and the word mark itself, are spelled in bytes.

The N best paths through a position use its N best ways to the end, so the search
visits no position more than N times: it is linear in long runs of one character,
where very many paths have equal scores. Among equal scores it visits positions
from the right, which puts all ways to the end from a position in order.

Defined results: a null text has null pieces; an empty text has none, one
segmentation, and decodes to itself; equal scores of a small lattice are ordered by
the ids of its pieces from the first one on (scores that add up exactly, such as
whole numbers, are equal in whatever order), those of a document by where they
deviate; repeated rows each keep their row. A segmentation appears once; texts with
fewer than N have all they have. The model's file must be at the given path on every
machine.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ixpanel.llm.common import field_of, prepare, table

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
N_BEST = 4
MARK = "▁"            # stands for a space; a text's own one is spelled in bytes
OWN_MARK = "\ud800"        # that one meanwhile: no UTF-8 text holds a lone surrogate
BYTE_PENALTY = 10.0        # a byte scores so much less than the worst piece
CACHE = 400_000            # small lattices a worker keeps


class Pieces:
    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, tuple[int, float]] = {}
        self.piece: dict[int, bytes] = {}
        self.byte: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.piece[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = (i, sp.get_score(i))
                self.piece[i] = p.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids) or len(self.byte) < 256:
            raise ValueError("the vocabulary needs word marks at the start of pieces, and all bytes")
        # Pieces by their text, and an empty entry for the beginning of one, where a search goes on.
        self.table: dict[str, tuple] = {p[:k]: () for p in self.ids for k in range(1, len(p))}
        self.table |= {p: ((i,), s) for p, (i, s) in self.ids.items()}
        self.bytes = pa.array([self.piece.get(i, b"") for i in range(sp.get_piece_size())], pa.binary())
        self.byte_score = min((s for _, s in self.ids.values()), default=0.0) - BYTE_PENALTY
        runs = "".join(f"[{''.join(map(re.escape, sorted(c)))}]+|" for c in self._classes())
        self.cut = re.compile(f"{MARK}*(?:{runs}[^{MARK}])|{MARK}+", re.DOTALL)

    def _classes(self) -> list[set[str]]:
        """Characters that are neighbours in a piece, directly or through others; small groups as one."""
        of: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in itertools.pairwise(p.lstrip(MARK)):
                x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
                if x is not y:
                    x |= y
                    of.update(dict.fromkeys(y, x))
        groups = list({id(c): c for c in of.values()}.values())
        rest = set().union(*(c for c in groups if len(c) < 20))
        return sorted((c for c in [rest, *groups] if c and (c is rest or len(c) >= 20)), key=lambda c: (-len(c), min(c)))

    def lattices(self, text: str) -> list[str]:
        """The small lattices of a text."""
        return self.cut.findall(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK))

    def edges(self, s: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """Edges of a small lattice in order of their start: (begin, end, ids, score)."""
        out, get, n = [], self.table.get, len(s)
        for a in range(n):
            single = False
            for b in range(a + 1, n + 1):
                if (found := get(s[a:b])) is None:
                    break
                if found:
                    out.append((a, b, *found))
                    single = single or b == a + 1
            if not single:
                out.append(self._bytes(s, a))
        return out

    def _bytes(self, s: str, a: int):
        raw = (MARK if s[a] == OWN_MARK else " " if s[a] == MARK else s[a]).encode()
        return a, a + 1, tuple(self.byte[x] for x in raw), len(raw) * self.byte_score

    def best(self, s: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best segmentation, and what the cheapest other one loses:
        Viterbi with the two best scores of each position."""
        n, get = len(s), self.table.get
        first, second, back = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1), [None] * (n + 1)
        for a in range(n):
            f, g = first[a], second[a]
            for b in range(a + 1, n + 1):
                found = get(s[a:b])
                if not found:
                    if b == a + 1:
                        _, _, ids, score = self._bytes(s, a)
                    elif found is None:
                        break
                    else:
                        continue
                else:
                    ids, score = found
                v, old = f + score, first[b]
                if v > old:
                    w = g + score
                    second[b] = old if old > w else w
                    first[b] = v
                    back[b] = a, ids
                elif v > second[b]:
                    second[b] = v
                if found is None:
                    break
        ids, b = [], n
        while b:
            b, last = back[b]
            ids.append(last)
        ids.reverse()
        return first[n], tuple(itertools.chain.from_iterable(ids)), first[n] - second[n]

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Up to ``n`` segmentations of a small lattice, best first."""
        into = [[] for _ in range(len(s) + 1)]
        best = [0.0] + [-np.inf] * len(s)
        for e in self.edges(s):
            into[e[1]].append(e)
            best[e[1]] = max(best[e[1]], best[e[0]] + e[3])
        # Backward A*: a state is a position and the pieces behind it; what is before costs best[] exactly.
        # Among equal scores: positions from the right, then the next piece, then the rank of what follows it.
        heap = [(-best[-1], -len(s), (), 0, 0.0, None)]
        visits = [0] * (len(s) + 1)
        least: list[list[float]] = [[] for _ in visits]      # the n best scores found for a position
        out: list[tuple[float, tuple[int, ...]]] = []
        while heap and len(out) < n:
            _, at, _, _, done, tail = heapq.heappop(heap)
            at = -at
            rank = visits[at]
            if rank == n:
                continue
            visits[at] += 1
            if not at:
                ids = []
                while tail:
                    ids += tail[0]
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for a, _, ids, score in into[at]:
                cost, known = -(best[a] + score + done), least[a]
                if visits[a] == n or len(known) == n and cost > known[-1]:
                    continue
                bisect.insort(known, cost)
                del known[n:]
                heapq.heappush(heap, (cost, -a, ids, rank, done + score, (ids, tail)))
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, each behind a space, as bytes; null for a null list."""
        pieces = self.bytes.take(ids.values)
        return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces, mask=ids.is_null()), b"")


class Encoder:
    """N-best lists of small lattices as flat arrays, filled as texts need them."""

    def __init__(self, model_file: str, n: int):
        self.pieces, self.n = Pieces(model_file), n
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.names: list[str] = []
        self.lists: dict[int, list[tuple[float, tuple[int, ...]]]] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.score, self.gap = np.empty(0), np.empty(0)

    def _add(self, names: list[str]):
        found = []
        for s in names:
            score, ids, gap = self.pieces.best(s)
            if gap <= 0:            # which of the equals comes first is the search's to say
                ids = self._list(len(self.names), s)[0][1]
            found.append((score, np.array(ids, np.int32), gap))
            self.rows[s] = len(self.names)
            self.names.append(s)
        self.flat = np.concatenate([self.flat, *(f[1] for f in found)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(f[1]) for f in found])])
        self.score = np.concatenate([self.score, [f[0] for f in found]])
        self.gap = np.concatenate([self.gap, [f[2] for f in found]])

    def _list(self, row: int, name: str):
        if row not in self.lists:
            self.lists[row] = self.pieces.n_best(name, self.n)
        return self.lists[row]

    def encode(self, texts: list[str]):
        """For each text: ids of the best, its score, and alternatives
        [(score, [(begin, end, ids)])]: what replaces which of the best's pieces."""
        if len(self.rows) > CACHE:
            self.clear()
        split = [self.pieces.lattices(t) if t else [] for t in texts]
        rows = self.rows
        new = [s for s in dict.fromkeys(itertools.chain.from_iterable(split)) if s not in rows]
        if new:
            self._add(new)
        for names in split:
            yield self._one(np.fromiter(map(rows.__getitem__, names), np.int64, len(names)))

    def _one(self, rows: np.ndarray):
        if not len(rows):
            return np.empty(0, np.int32), 0.0, []
        size = self.at[rows + 1] - self.at[rows]
        end = np.cumsum(size)
        begin = end - size
        ids = self.flat[np.repeat(self.at[rows] - begin, size) + np.arange(end[-1])]
        total = float(self.score[rows].sum())
        gap = self.gap[rows]
        k = min(self.n - 1, len(rows))
        if k < 1:
            return ids, total, []
        limit = np.partition(gap, k - 1)[k - 1]
        places = np.concatenate([np.nonzero(gap < limit)[0], np.nonzero(gap == limit)[0]])[:k]
        places = np.sort(places[np.isfinite(gap[places])])
        merged: list[tuple[float, tuple]] = [(0.0, ())]
        for p in places.tolist():
            own = self._list(int(rows[p]), self.names[rows[p]])
            merged = sorted(((loss + own[0][0] - s, change + (((p, c),) if c else ()))
                             for loss, change in merged for c, (s, _) in enumerate(own)))[:self.n]
        return ids, total, [
            (total - loss, [(int(begin[p]), int(end[p]), list(self.lists[int(rows[p])][c][1])) for p, c in change])
            for loss, change in merged[1:]]


EDIT = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("ids", pa.list_(pa.int32()))])
ALTERNATIVE = pa.struct([("score", pa.float64()), ("edits", pa.list_(EDIT))])
OUT = ("ids array<int>, score double, "
       "alternatives array<struct<score: double, edits: array<struct<begin: int, end: int, ids: array<int>>>>>")
_ENCODERS: dict = {}


def _encoder(model_file: str, n: int) -> Encoder:
    if (model_file, n) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model_file, n] = Encoder(model_file, n)
    return _ENCODERS[model_file, n]


def _ids(found: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in found)])
    flat = np.concatenate([np.empty(0, np.int32), *(x for x in found if x is not None)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)),
                                    mask=pa.array([x is None for x in found], pa.bool_()))


def _behind_space(raw: bytes | None) -> bytes | None:
    return raw and raw[1:]          # nothing for no pieces


def encode(docs: DataFrame, n: int = N_BEST, model_file: str = MODEL, back: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ids of the best segmentation, its score, and
    the next n - 1 as alternatives: their scores, and what replaces pieces begin to end of ids.
    back: the ids are decoded as well: decoded_sha256 (of the text they give, null if that is null)
    and exact (whether that is the row's text)."""
    def run(batches):
        encoder = _encoder(model_file, n)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, scores, others = [], [], []
            for text, (best, score, alternatives) in zip(texts, encoder.encode(texts)):
                ids.append(best if text is not None else None)
                scores.append(score if text is not None else None)
                others.append([{"score": s, "edits": [{"begin": a, "end": b, "ids": x} for a, b, x in edits]}
                               for s, edits in alternatives] if text is not None else None)
            columns = {"doc_id": batch.column(0), "ids": _ids(ids),
                       "score": pa.array(scores, pa.float64()), "alternatives": pa.array(others, pa.list_(ALTERNATIVE))}
            if back:
                given = [_behind_space(x) for x in encoder.pieces.decode(columns["ids"]).to_pylist()]
                columns["decoded_sha256"] = pa.array(
                    [None if x is None else hashlib.sha256(x).hexdigest() for x in given], pa.string())
                columns["exact"] = pa.array([x == (text if text is None else text.encode())
                                             for x, text in zip(given, texts)], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns)

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{field_of(docs, 'doc_id')}, {OUT}" + (", decoded_sha256 string, exact boolean" if back else ""))


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, ids): doc_id and the text."""
    def run(batches):
        pieces = _encoder(model_file, N_BEST).pieces
        for batch in batches:
            text = [_behind_space(x) for x in pieces.decode(batch.column(1).cast(pa.list_(pa.int32()))).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary()).cast(pa.string())],
                                             ["doc_id", "text"])

    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, f"{field_of(encoded, 'doc_id')}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), back=True)
