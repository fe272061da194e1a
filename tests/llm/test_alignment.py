"""Cross-tokenizer alignment against the tokenizers' own ids and links counted one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ixpanel.llm import alignment
from ixpanel.llm.common import cut, table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a", "  two  spaces \n\n\t x ", "▁ own mark", "<|endoftext|> is text", "<s> </s> <unk>", "<0x41>",
       "ä💥é日本語テキスト" * 5, "-" * 201, "=" * 3001, "a" * 2500, " " * 900, "\n" * 77, "\x00\x01\u0085", "word " * 4000,
       "🏳️‍🌈" * 40, "I've we'll 1234567 x=y;//", "퟿\U0010ffff"]


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, alignment._tokenizers(alignment.BYTE_BPE, alignment.PIECES)


def simple_groups(a, b, of):
    """Token by token: whichever side is behind takes its next one."""
    out, i, j, x, y, p, q = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            x, p, i = x + int(of.a_size[a[i]]), p + [a[i]], i + 1
        else:
            y, q, j = y + int(of.b_size[b[j]]), q + [b[j]], j + 1
        if x == y:
            out.append((p, q))
            p, q = [], []
    return out


def brute(texts, tokenizers):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, digest of the groups."""
    own, of = tokenizers
    groups = []
    for text in texts:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = of._b.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(of.a_bytes[i] for i in a) != want or b"".join(of.b_bytes[i] for i in b) != want:
            groups.append([])
            continue
        groups.append(simple_groups(a, b, of))
    links = [Counter((x, y) for p, q in g for x in p for y in q) for g in groups]
    count = Counter(pair for c in links for pair in c)
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [(sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()),
             sum(n for p, n in c.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in c.items()),
             hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g).encode()).hexdigest()
             if g else "") for g, c in zip(groups, links)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_common_ends_of_any_arrays():
    rng = random.Random(1)
    for _ in range(400):
        last = rng.randint(1, 400)
        a, b = ([*sorted(rng.sample(range(1, last), rng.randint(0, last - 1))), last] for _ in range(2))
        if rng.random() < 0.5:
            b = sorted(set(a) - set(rng.sample(a[:-1], len(a[:-1]) // 9)))
        x, y = alignment.common_ends(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[i - 1] for i in x] == common == [b[j - 1] for j in y]
    assert [len(v) for v in alignment.common_ends(np.empty(0), np.empty(0))] == [0, 0]
    n = np.arange(1, 1_000_001)
    assert (alignment.common_ends(n, n)[0] == n).all()


def test_a_is_encoded_as_its_file_says(tokenizers):
    own, of = tokenizers
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 50_000):      # every character, next to letters, digits, marks and itself
        texts = [f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}. {chr(c)}{chr(c)} x" for c in points[k:k + 50_000:3]]
        want = own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        assert [e.ids for e in want] == [of._a.encode_ordinary(" " + t) for t in texts]


def given(df):
    return sorted((str(r.doc_id), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_query_like_links_one_by_one(spark, tokenizers):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = brute([r.text for r in docs], tokenizers)
    assert given(alignment.query(spark, SF)) == sorted((str(r.doc_id), *w) for r, w in zip(docs, want))


@pytest.mark.parametrize("wide", [4096, 2, 0])
def test_pairs_of_odd_texts(tokenizers, monkeypatch, wide):
    monkeypatch.setattr(alignment, "WIDE", wide)
    x = alignment.Aligned(tokenizers[1].encode([t or "" for t in ODD]), tokenizers[1])
    for k, c in enumerate(brute(ODD, tokenizers)):
        pairs = {(int(p) // x.n_b_ids, int(p) % x.n_b_ids): int(n) for p, n in zip(
            x.pairs[x.starts[k]:x.starts[k + 1]], x.times[x.starts[k]:x.starts[k + 1]])}
        assert pairs == alignment.brute_pairs(x.groups[k].as_py()) and sum(pairs.values()) == c[3]
    parts = list(alignment._parts(["x" * 150, "", "y" * 100, "z" * 900, ""]))
    assert parts[0][0] == 0 and parts[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 1])
def test_odd_tables(spark, tokenizers, chunk):
    rows = [(k, t, "s", 1, 2) for k, t in enumerate(ODD)] + [(None, "word word", "s", 1, 2)] + [(7, "word word", "s", 1, 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, chunk long, n_best int").repartition(5)
    of = tokenizers[1]
    got = alignment.with_counts(cut(alignment.align(df, chunk_pairs=chunk)), len(of.b_bytes)).collect()
    want = brute([r[1] for r in rows], tokenizers)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert sorted((str(r.doc_id), *(r[c] for c in COLUMNS[:-1]), digest(r.groups)) for r in got) == \
        sorted((str(r[0]), *w) for r, w in zip(rows, want))
    assert alignment.with_counts(cut(alignment.align(df.where("false"))), len(of.b_bytes)).count() == 0


def test_very_long_text(tokenizers):
    text = "".join(random.Random(3).choice("abc déf\n-=") for _ in range(400_000))
    x = alignment.Aligned(tokenizers[1].encode([text, "", "end"]), tokenizers[1])
    assert x.n_links[0] == sum(x.times[:x.starts[1]]) and x.n_groups[1] == 0 and x.n_groups[2] > 0
