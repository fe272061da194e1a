"""Quality classifier: a weak-label model and a hashed linear scorer trained on its posteriors.

Heuristic labellers vote on each text: bad, good, or nothing. Expectation-maximisation
estimates, from how the votes of all documents agree and without any label, the share
of bad texts and each labeller's rates of votes on bad and on good ones. It runs on the
counts of distinct vote patterns (at most 3 to the number of labellers), which cover
every document. The posterior of a pattern is the weak label of its documents.

A bounded sample of about SAMPLE documents, picked by a hash of doc_id, then trains a
logistic scorer on hashed features: trigrams of character classes and 4-grams of bytes,
each as its mean weight over the text. The scorer sees whole texts, never the votes.

Defined results: a null text is an empty one; an empty text has no feature but the bias
and the labellers call it bad; an empty table gives an empty result; repeated rows each
keep their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, field_of, prepare, table

SAMPLE = 4000
KEEP = 0.5
CLASSES = 16
BUCKETS = 1 << 15
STEP = 1 << 16              # bytes of a text looked at together
SYMBOLS = b"#$%&*^~<>{}[]\\|=@_"
_KIND = np.full(256, 1, np.uint8)                       # 1: other ASCII
for _c in range(256):
    _s = bytes([_c])
    _KIND[_c] = (2 if _s.islower() or _c >= 128 else 3 if _s.isupper() else 4 if _s.isdigit() else 5 if _s == b" "
                 else 6 if _s == b"\n" else 7 if _s in b".,;:" else 8 if _s in b"!?" else 9 if _s == b"|"
                 else 10 if _s in b"#$%&*" else 11 if _s in b"'\"()-" else 0 if _c < 32 else 1)


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def _deleted(text: bytes, what: bytes) -> int:
    return len(text) - len(text.translate(None, what))


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123)) + bytes(range(128, 256))


def votes(text: bytes) -> str:
    """One character for each labeller: - bad, + good, 0 nothing."""
    n, words, lines = len(text), text.split(), [x for x in text.split(b"\n") if x.strip()]
    upper, lower = _deleted(text, _UPPER), _deleted(text, _LOWER)
    ends = sum(text.count(c) for c in (b". ", b".\n", b", ")) + text.endswith(b".")
    repeated = _share(len(lines) - len(set(lines)), len(lines))
    vote = lambda bad, good=False: "-" if bad else "+" if good else "0"
    return "".join((
        vote(_share(_deleted(text, SYMBOLS), n) > 0.03),
        vote(sum(text.count(bytes([c]) * 3) for c in SYMBOLS) > 0.05 * len(words)),
        vote(_share(upper, upper + lower) > 0.4, _share(upper, upper + lower) < 0.15),
        vote(text.count(b"|") > 0.1 * len(words)),
        vote(text.count(b"!") > 0.2 * len(words)),
        vote(len(words) < 3),
        vote(len(lines) > 3 and repeated > 0.3),
        vote(len(words) > 40 and _share(len(set(words)), len(words)) < 0.15),
        vote(_share(_deleted(text, b"0123456789"), n) > 0.15),
        vote(False, len(words) >= 3 and 0.02 < _share(ends, len(words)) < 0.6),
        vote(len(words) > 2 and not 2.5 < _share(upper + lower, len(words)) < 14),
    ))


class LabelModel:
    """Share of bad texts, and each labeller's rates of -, 0 and + on good (0) and bad (1) ones."""

    def __init__(self, counts: dict[str, int], rounds: int = 50, prior: float = 1.0):
        self.patterns = sorted(counts)
        n = np.array([counts[p] for p in self.patterns], float)
        codes = np.array([["-0+".index(c) for c in p] for p in self.patterns])
        bad = np.where((codes == 0).any(axis=1), 0.9, 0.1)          # labellers that object are mostly right
        for _ in range(rounds):
            weight = np.stack([(1 - bad) * n, bad * n])
            self.share = (weight[1].sum() + prior) / (n.sum() + 2 * prior)
            self.rates = np.stack([[[weight[y][codes[:, k] == v].sum() for v in range(3)]
                                    for k in range(codes.shape[1])] for y in range(2)]) + prior / 10
            self.rates /= self.rates.sum(axis=2, keepdims=True)
            log = np.stack([np.log(self.rates[y][np.arange(codes.shape[1]), codes]).sum(axis=1) for y in range(2)])
            bad = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 / self.share - 1), -500, 500)))
        self.good = dict(zip(self.patterns, (1 - bad).tolist()))


def _codes(text: bytes):
    """Feature numbers of a text, STEP bytes at a time: class trigrams, then hashed byte 4-grams."""
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), STEP):
        part = raw[at:at + STEP + 3]
        k = _KIND[part].astype(np.int32)
        yield (k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:]
        b = part.astype(np.uint32)
        if len(b) > 3:
            yield ((((b[:-3] * 257 + b[1:-2]) * 257 + b[2:-1]) * 257 + b[3:]) * np.uint32(2654435761)
                   >> np.uint32(17)).astype(np.int32) % BUCKETS + CLASSES ** 3


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(CLASSES ** 3 + BUCKETS)
    for c in _codes(text):
        total += np.bincount(c, minlength=len(total))
    at = np.nonzero(total)[0]
    return at, total[at] / max(1, len(text))


class Scorer:
    """Logistic regression on hashed features; weights[-1] is the bias."""

    def __init__(self, rows, epochs: int = 30, rate: float = 0.5, l2: float = 1e-6):
        self.weights = np.zeros(CLASSES ** 3 + BUCKETS + 1)
        seen = np.full(len(self.weights), 1e-8)
        rng = np.random.default_rng(0)
        scale = 10.0                                          # of the features, which are shares
        for _ in range(epochs):
            for r in rng.permutation(len(rows)):
                at, value, target = rows[r]
                at, value = np.append(at, len(seen) - 1), np.append(value * scale, 1.0)
                wrong = 1 / (1 + np.exp(-np.clip(self.weights[at] @ value, -30, 30))) - target
                grad = wrong * value + l2 * self.weights[at]
                seen[at] += grad * grad
                self.weights[at] -= rate * grad / np.sqrt(seen[at])
        self.weights[:-1] *= scale

    def score(self, text: bytes) -> float:
        total = sum(float(self.weights[c].sum()) for c in _codes(text))
        return float(1 / (1 + np.exp(-np.clip(total / max(1, len(text)) + self.weights[-1], -30, 30))))


def _voted(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([votes(t or b"") for t in b.column(1).to_pylist()])],
                                         ["doc_id", "votes"])


def _featured(batches):
    for b in batches:
        rows = [(v, *features(t or b"")) for t in b.column(1).to_pylist() for v in (votes(t or b""),)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()),
             pa.array([r[2].astype(np.float32).tobytes() for r in rows], pa.binary())], ["votes", "at", "value"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer] | None:
    """The label model of all of ``docs`` (doc_id, text), and a scorer of the sample; None without rows."""
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("binary"))
    counts = {r["votes"]: r["count"] for r in
              rows.mapInArrow(_voted, f"{field_of(docs, 'doc_id')}, votes string").groupBy("votes").count().collect()}
    if not counts:
        return None
    labels = LabelModel(counts)
    # Texts are picked by their own hash, each once, however often and under whatever number it occurs.
    rate = min(1.0, sample / sum(counts.values()))
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    some = docs.select(key, F.col("text").cast("binary")).where(
        F.pmod("key", F.lit(1 << 30)) < int(rate * (1 << 30))).dropDuplicates(["key"]).mapInArrow(
        _featured, "votes string, at binary, value binary").toLocalIterator()
    some = sorted((bytes(r["at"]), bytes(r["value"]), labels.good[r["votes"]]) for r in some)    # any order, the same fit
    return labels, Scorer([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for a, v, y in some])


def classify(docs: DataFrame, fitted: tuple[LabelModel, Scorer] | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (of the scorer, 1 is good), votes and weak_label
    (posterior of good)."""
    prepare(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(fitted)     # patterns and weights: of fixed size

    def run(batches):
        labels, scorer = bc.value or (None, None)
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            vote = [votes(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([scorer.score(t) if scorer else 0.5 for t in texts], pa.float64()),
                 pa.array(vote, pa.string()),
                 pa.array([labels.good.get(v, 0.5) if labels else 0.5 for v in vote], pa.float64())],
                ["doc_id", "score", "votes", "weak_label"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, f"{field_of(docs, 'doc_id')}, score double, votes string, weak_label double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs)).withColumn("kept", F.col("score") >= KEEP)
