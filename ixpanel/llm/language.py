"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a language. Emission scores come from hashed affix,
n-gram and lexicon features; learned transitions couple neighbouring words, and
forward-backward gives each word's posterior, so passages in a second language
are told apart. A document's language is the one with the largest expected
number of words; its score is that share.

Learning takes a bounded sample: about ``docs_per_lang`` documents of each
language, picked by a hash of their text (each text once) over all labelled rows
that aren't held out, and about ``windows_per_lang`` windows of WINDOW words out
of these. Only text and lang are used; every label is learned, so a model grows
with the number of languages. Prediction reads text alone, and all of it.

Forward-backward runs over all words of many documents at once: they form one
chain whose transition at a document's first word forgets what came before. The
chain is cut into segments; products of the segments' matrices link them.

Defined results: null or empty texts, and texts without a letter, are ``und``
with score 0; so is every text if there is no labelled row to learn from. Ties
go to the language first in order. Rows with a null lang are predicted but not
learned from; rows with a null doc_id count as not held out, and are not
learned from. Repeated rows each keep their row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import field_of, prepare, table

BUCKETS = 1 << 16
WINDOW = 32
DOCS_PER_LANG = 400
WINDOWS_PER_LANG = 1500
CHUNK_WORDS = 200_000      # words of one forward-backward pass
CACHE_WORDS = 200_000      # word types a worker keeps
EPOCHS, RATE, L2 = 6, 0.3, 1e-5
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint32) ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
    return ((x ^ (x >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int64) % BUCKETS


def features(words: list[str], lexicon: dict) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the hashed features of distinct words: each word itself, its lexicon
    entry, its affixes of 1 to 4 bytes, and its padded 2- and 3-grams of bytes."""
    raw = np.frombuffer(("^" + "$^".join(words) + "$").encode(), np.uint8)
    begin, end = np.nonzero(raw == 94)[0], np.nonzero(raw == 36)[0]
    owner = np.repeat(np.arange(len(words)), end - begin + 1)
    b = raw.astype(np.uint32)
    every = np.arange(len(words))
    out = [(every, _bucket(np.array([zlib.crc32(w.encode()) for w in words], np.uint32), 1)),
           (every, _bucket(np.array([zlib.crc32(lexicon.get(w, "-").encode()) for w in words], np.uint32), 2)),
           (every, _bucket(np.zeros(len(words)), 3))]
    two = np.nonzero(raw[:-1] != 36)[0]
    out.append((owner[two], _bucket(b[two] * np.uint32(257) + b[two + 1], 4)))
    three = two[:-1][raw[two[:-1] + 1] != 36]
    out.append((owner[three], _bucket((b[three] * np.uint32(257) + b[three + 1]) * np.uint32(257) + b[three + 2], 5)))
    head, tail = np.zeros(len(words), np.uint32), np.zeros(len(words), np.uint32)
    for k in range(1, 5):
        long = np.nonzero(end - begin > k)[0]
        head[long] = head[long] * np.uint32(257) + b[begin[long] + k]
        tail[long] = tail[long] * np.uint32(257) + b[end[long] - k]
        out += [(long, _bucket(head[long], 10 + k)), (long, _bucket(tail[long], 20 + k))]
    return tuple(np.concatenate(x) for x in zip(*out))


def messages(score: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray):
    """Forward messages, backward messages and emission factors at each position, each (n, k)
    and scaled per position. score: emission scores; first: where a sequence begins;
    start (k), step (k, k): transition scores."""
    n, k = score.shape
    length = max(1, int(np.sqrt(n)))
    parts = -(-n // length)
    pad = parts * length - n
    x = np.exp(score - score.max(axis=1, keepdims=True))
    x = np.concatenate([x, np.ones((pad, k))]).reshape(parts, length, k).transpose(1, 0, 2).copy()
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(parts, length).T
    begin = np.exp(start - start.max())
    begin /= begin.sum()
    move = np.exp(step - step.max())
    jump = np.broadcast_to(begin, (k, k))
    moves = [np.where(new[t][:, None, None], jump, move) if new[t].any() else move for t in range(length)]
    whole = np.broadcast_to(np.eye(k), (parts, k, k))
    for t in range(length):
        whole = (whole @ moves[t]) * x[t][:, None, :]
        whole /= whole.sum(axis=(1, 2))[:, None, None]
    ahead, behind = np.empty((parts, k)), np.empty((parts, k))
    a, b = np.full(k, 1 / k), np.full(k, 1 / k)
    for s in range(parts):
        ahead[s] = a
        a = a @ whole[s]
        a /= a.sum()
    for s in range(parts - 1, -1, -1):
        behind[s] = b
        b = whole[s] @ b
        b /= b.sum()
    alpha = np.empty((length, parts, k))
    a = ahead
    for t in range(length):
        a = np.where(new[t][:, None], a.sum(axis=1, keepdims=True) * begin, a @ move) * x[t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[t] = a
    beta = np.empty((length, parts, k))
    b = behind
    for t in range(length - 1, -1, -1):
        beta[t] = b
        y = x[t] * b
        b = np.where(new[t][:, None], (y @ begin)[:, None], y @ move.T)
        b /= b.sum(axis=1, keepdims=True)
    return tuple(m.transpose(1, 0, 2).reshape(parts * length, k)[:n] for m in (alpha, beta, x))


def posteriors(score: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Posterior of each label at each position (n, k)."""
    alpha, beta, _ = messages(score, first, start, step)
    post = alpha * beta
    return post / post.sum(axis=1, keepdims=True)


def pair_counts(alpha, beta, x, first, step) -> np.ndarray:
    """Expected number of each transition (k, k)."""
    inner = np.nonzero(~first)[0]
    joint = alpha[inner - 1][:, :, None] * (x[inner] * beta[inner])[:, None, :] * np.exp(step - step.max())
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Model:
    """Languages, feature weights, transition scores and lexicon; a cache of emission scores."""

    def __init__(self, langs, weights, start, step, lexicon):
        self.langs, self.weights, self.start, self.step, self.lexicon = langs, weights, start, step, lexicon
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "scores")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(self.langs)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if new:
            owner, bucket = features(new, self.lexicon)
            made = np.stack([np.bincount(owner, self.weights[bucket, y], len(new)) for y in range(len(self.langs))], axis=1)
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            self.scores = np.concatenate([self.scores, made.astype(np.float32)])
        return self.scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each list of words: expected words of each language, and each word's language."""
        size = [len(t) for t in texts]
        if not sum(size):
            return [(np.zeros(len(self.langs)), np.empty(0, int)) for _ in texts]
        first = np.zeros(sum(size), bool)
        at = np.concatenate([[0], np.cumsum(size)])
        first[at[:-1][np.array(size) > 0]] = True
        post = posteriors(self.emissions([w for t in texts for w in t]).astype(np.float64),
                          first, self.start, self.step)
        best = post.argmax(axis=1)
        return [(post[a:b].sum(axis=0), best[a:b]) for a, b in zip(at[:-1], at[1:])]


def fit(sequences: list[tuple[list[str], str]]) -> Model:
    """Fit the field to word sequences with one language each, by AdaGrad on its log-likelihood."""
    langs = sorted({y for _, y in sequences})
    k = len(langs)
    counts: dict[str, Counter] = {}
    for words, y in sequences:
        for w in words:
            counts.setdefault(w, Counter())[y] += 1
    lexicon = {}
    for w, c in counts.items():
        y, top = min(c.items(), key=lambda e: (-e[1], e[0]))
        if (total := sum(c.values())) >= 3:
            lexicon[w] = y if top >= 0.9 * total else "?"
    types = {w: i for i, w in enumerate(counts)}
    owner, bucket = features(list(counts), lexicon) if counts else (np.zeros(0, int), np.zeros(0, int))
    feats = np.split(bucket[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner))[:-1]) if counts else []
    weights, start, step = np.zeros((BUCKETS, k), np.float32), np.zeros(k), np.zeros((k, k))
    seen, seen_step, seen_start = np.full((BUCKETS, k), 1e-8, np.float32), np.full((k, k), 1e-8), np.full(k, 1e-8)
    rng = np.random.default_rng(0)
    order = np.arange(len(sequences))
    for _ in range(EPOCHS if k > 1 else 0):
        rng.shuffle(order)
        for at in range(0, len(order), 128):
            batch = [sequences[i] for i in order[at:at + 128]]
            ids = np.array([types[w] for words, _ in batch for w in words])
            used, ids = np.unique(ids, return_inverse=True)
            flat = np.concatenate([feats[i] for i in used])
            size = np.array([len(feats[i]) for i in used])
            score = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            length = np.array([len(words) for words, _ in batch])
            first = np.zeros(len(ids), bool)
            first[np.concatenate([[0], np.cumsum(length)[:-1]])] = True
            gold = np.repeat([langs.index(y) for _, y in batch], length)
            alpha, beta, x = messages(score[ids].astype(np.float64), first, start, step)
            wrong = alpha * beta
            wrong /= wrong.sum(axis=1, keepdims=True)
            wrong[np.arange(len(gold)), gold] -= 1
            by_type = np.zeros((len(used), k))
            np.add.at(by_type, ids, wrong)
            grad = np.zeros((BUCKETS, k), np.float32)
            np.add.at(grad, flat, np.repeat(by_type, size, axis=0).astype(np.float32))
            grad = grad / len(batch) + L2 * weights
            seen += grad * grad
            weights -= RATE * grad / np.sqrt(seen)
            pair = pair_counts(alpha, beta, x, first, step)
            inner = np.nonzero(~first)[0]
            np.subtract.at(pair, (gold[inner - 1], gold[inner]), 1)
            pair = pair / len(batch) + L2 * step
            seen_step += pair * pair
            step -= RATE * pair / np.sqrt(seen_step)
            head = wrong[first].sum(axis=0) / len(batch)
            seen_start += head * head
            start -= RATE * head / np.sqrt(seen_start)
    return Model(langs, weights, start, step, lexicon)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG,
           windows_per_lang: int = WINDOWS_PER_LANG) -> list[tuple[list[str], str]]:
    """The bounded training sample: about ``windows_per_lang`` windows of each language. Texts and
    windows are picked by their own hash, each text once, so neither its number nor its copies matter."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out()).select(
        "lang", "text", F.xxhash64("text").alias("key"))
    counts = rows.groupBy("lang").count().collect()           # one row a language
    if not counts:
        return []

    def picked(n: int, of: dict, *key) -> F.Column:
        rate = F.create_map(*(F.lit(x) for lang, c in of.items() for x in (lang, min(1.0, n / c))))
        return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30)

    some = rows.where(picked(docs_per_lang, {r["lang"]: r["count"] for r in counts}, F.col("key"))).dropDuplicates(
        ["lang", "key"]).select("key", "lang", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("words"))
    some = some.where("size(words) > 0").select("key", "lang", "words", F.explode(
        F.sequence(F.lit(1), F.size("words"), F.lit(WINDOW))).alias("at")).select(
        "key", "lang", "at", F.slice("words", F.col("at"), WINDOW).alias("words"))
    of = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
    if not of:
        return []
    some = some.where(picked(windows_per_lang, of, F.col("key"), F.col("at"), F.lit(7)))
    return [(r["words"], r["lang"]) for r in some.orderBy(
        "lang", F.xxhash64("key", "at"), F.array_join("words", " ")).select("words", "lang").collect()]


OUT = ("lang_pred string, score double, n_words long, shares array<double>, "
       "segments array<struct<begin: long, lang: string>>")


def _predict(bc):
    def chunks(texts):
        out, size = [], 0
        for t in texts:
            out.append(words_of(t))
            size += len(out[-1])
            if size >= CHUNK_WORDS:
                yield out
                out, size = [], 0
        if out:
            yield out

    def run(batches):
        model = bc.value
        langs = model.langs if model else []
        for batch in batches:
            pred, score, n, shares, segments = [], [], [], [], []
            for words in chunks(batch.column(1).to_pylist()):
                labelled = model.label(words) if model else [(np.zeros(0), np.empty(0, int))] * len(words)
                for text, (expected, best) in zip(words, labelled):
                    n.append(len(text))
                    if not len(best):
                        pred.append("und"), score.append(0.0), shares.append([]), segments.append([])
                        continue
                    share = expected / len(best)
                    top = int(share.argmax())
                    pred.append(langs[top])
                    score.append(min(1.0, float(share[top])))
                    shares.append(share.tolist())
                    at = np.concatenate([[0], np.nonzero(np.diff(best))[0] + 1])
                    segments.append([{"begin": a, "lang": langs[y]} for a, y in zip(at.tolist(), best[at].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                pa.array(n, pa.int64()), pa.array(shares, pa.list_(pa.float64())),
                pa.array(segments, pa.list_(pa.struct([("begin", pa.int64()), ("lang", pa.string())])))],
                ["doc_id", "lang_pred", "score", "n_words", "shares", "segments"])
    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): lang_pred, score, n_words, shares (of the
    model's languages) and segments (word position from which on words are of a language)."""
    prepare(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(model)     # BUCKETS x languages, and the sample's lexicon
    return docs.select("doc_id", "text").mapInArrow(_predict(bc), f"{field_of(docs, 'doc_id')}, {OUT}")


def accepted(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) with a letter and a share of at least
    ``min_score`` of their words in one language, in one pass that carries the whole rows."""
    def run(batches, at=docs.columns.index("text")):
        for batch in batches:
            for found in predict([pa.RecordBatch.from_arrays([batch.column(at)] * 2, ["doc_id", "text"])]):
                yield batch.filter(pc.and_(pc.not_equal(found["lang_pred"], "und"),
                                           pc.greater_equal(found["score"], min_score)))

    prepare(docs.sparkSession)
    predict = _predict(docs.sparkSession.sparkContext.broadcast(model))      # as in identify
    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, **bounds) -> Model | None:
    """A model of the sample of ``docs`` (doc_id, text, lang); None if nothing is labelled."""
    found = sample(docs, **bounds)
    return fit(found) if found else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score",
        F.greatest(F.size("segments") - 1, F.lit(0)).cast("long").alias("n_switches"))
