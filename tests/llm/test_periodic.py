"""Periodic runs against a search of every period, and the registered query against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ixpanel.llm import periodic
from ixpanel.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every period, every stretch; of equal stretches the smallest period."""
    n, period = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            b = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - b >= 2 * q:
                period.setdefault((b, i + q), q)
            i = max(i, b + 1)
    return sorted(((b, e - b, q) for (b, e), q in period.items() if e - b >= max(least, 2 * q)),
                  key=lambda r: (r[0], r[2]))


def _touching(rng, n):
    """Runs of one short period that touch out of step."""
    unit = [rng.randrange(2) for _ in range(rng.randint(1, 4))]
    out = []
    while len(out) < n:
        s = rng.randrange(len(unit))
        out += (unit * 200)[s:s + rng.randint(4, 120)] + [rng.randrange(3)] * (rng.random() < 0.4)
    return out


def _copied(rng, n):
    out = []
    while len(out) < n:
        if out and rng.random() < 0.7:
            size = rng.randint(1, len(out))
            at = rng.randint(0, len(out) - size)
            out += out[at:at + size] * rng.randint(1, 3)
        else:
            out += [rng.randrange(4) for _ in range(rng.randint(1, 9))]
    return out[:500]


def _fibonacci(rng, n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


MAKERS = [_touching, _copied, _fibonacci,
          lambda rng, n: [rng.randrange(2) for _ in range(n)],
          lambda rng, n: [0] * n,
          lambda rng, n: ([rng.randrange(3) for _ in range(rng.randint(1, 60))] * 60)[:n],
          lambda rng, n: ([0] * rng.randint(1, 60) + [1] * rng.randint(0, 2)) * rng.randint(2, 4)]


@pytest.mark.parametrize("maker", range(len(MAKERS)))
def test_all_runs_like_every_period(maker):
    rng = random.Random(maker)
    for _ in range(25):
        docs = [MAKERS[maker](rng, rng.choice([0, 1, 11, 12, 13, 40, 100, 300])) for _ in range(rng.randint(1, 8))]
        assert periodic.runs_of([np.array(d, np.int32) for d in docs]) == [brute(d) for d in docs]


def test_a_hash_without_meaning_loses_no_run(monkeypatch):
    # With names that collide nearly always, only more positions are compared.
    monkeypatch.setattr(periodic, "_mix", lambda x: (x * np.uint64(31)) % np.uint64(3))
    rng = random.Random(5)
    for _ in range(20):
        d = rng.choice(MAKERS[:6])(rng, 150)
        assert periodic.runs_of([np.array(d, np.int32)]) == [brute(d)]


def test_long_runs_take_little():
    n = 300_000
    assert periodic.runs_of([np.zeros(n, np.int32)]) == [[(0, n, 1)]]
    unit = np.random.default_rng(1).integers(0, 9, 70_001).astype(np.int32)
    found = periodic.runs_of([np.concatenate([unit, unit, unit[:50_000]])])[0]
    assert (0, 190_002, 70_001) in found


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_like_plain_python(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in periodic.query(spark, SF).collect()}
    short = {i for i, t in docs.items() if len((t or "").split()) <= 700}
    assert got.keys() == docs.keys() and len(short) > 120
    assert {i: got[i] for i in short} == {i: expected(i, docs[i]) for i in short}
    assert sum(v[0] > 0 for v in got.values()) > 15


def test_odd_tables(spark):
    odd = "a b   c\x0bd\x1ce\x85"
    texts = [None, "", " \n\t", odd, odd * 20, "a b " * 40, "a b " * 40, "x " * 30_000, "wörd " * 12]
    rows = [(i, t, "l", 1, "s") for i, t in enumerate(texts)] + [(None, "a b " * 40, "l", 1, "s"), (10, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed long, best string")
    got = [(r.doc_id, *(r[c] for c in COLUMNS)) for r in periodic.digests(periodic.periodic(df, edit=periodic.repeated)).collect()]
    want = [(r[0], *expected(r[0], r[1])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    plain = periodic.periodic(df.where("doc_id = 5")).first()
    assert [tuple(r) for r in plain.runs] == [(0, 80, 2)] and plain.collapsed == "a b"
    assert periodic.digests(periodic.periodic(df.where("false"))).count() == 0
    with pytest.raises(ValueError):
        periodic.runs_of([], 5)


def test_plan_has_no_shuffle(spark):
    plan = periodic.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
