"""Language field, piece lattices, vectors, quality, archives and the pipeline."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ixpanel.llm import embeddings, language, pieces, quality, warc
from ixpanel.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, votes string"


def docs(spark, rows, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", None, 1.0, "v") for i, t in rows], DOCS)


# ---------------------------------------------------------------- language

def test_forward_backward_like_enumeration():
    rng = np.random.default_rng(1)
    score, start, step = rng.normal(size=(9, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first = np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in ((0, 4), (4, 5), (5, 9)):
        total, part = 0.0, np.zeros((b - a, 3))
        part_pairs = np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=b - a):
            v = np.exp(start[y[0]] + sum(score[a + i, y[i]] for i in range(b - a))
                       + sum(step[y[i - 1], y[i]] for i in range(1, b - a)))
            total += v
            for i, k in enumerate(y):
                part[i, k] += v
                if i:
                    part_pairs[y[i - 1], k] += v
        want[a:b], pairs = part / total, pairs + part_pairs / total
    assert np.allclose(language.posteriors(score, first, start, step), want)
    assert np.allclose(language.pair_counts(*language.messages(score, first, start, step), first, step), pairs)


def test_held_out_accuracy_and_no_leak(spark):
    rows = table(spark, SF, "documents")
    model = language.learn(rows)
    got = language.identify(rows, model).join(rows.select("doc_id", "lang"), "doc_id").where(language.held_out()).toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    # Labels of held-out rows aren't learned from: the sample has none of their texts.
    wrong = rows.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert {y for _, y in language.sample(wrong, 30, 100)} == {"de", "en", "es", "fr"}
    # Code-switched text: the second half is of another language.
    en = " ".join(w for w, y in language.sample(rows, 5, 40) if y == "en" for w in w[:8])
    fr = " ".join(w for w, y in language.sample(rows, 5, 40) if y == "fr" for w in w[:8])
    both = language.identify(docs(spark, [(1, en + " " + fr)]), model).first()
    langs = [s.lang for s in both.segments]
    assert langs[0] == "en" and langs[-1] == "fr" and len(langs) <= 5


def test_texts_without_letters(spark):
    rows = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.learn(rows)
    texts = [None, "", "12 ½ ²  !?", "the of", "the " * 60000]
    got = {r.doc_id: r for r in language.identify(docs(spark, list(enumerate(texts)) + [(3, "the of")]), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[3].lang_pred == got[4].lang_pred == "en" and got[4].n_words == 60000
    assert language.learn(docs(spark, [(1, "no label")])) is None
    assert language.identify(docs(spark, [(1, "no label")]), None).first().lang_pred == "und"
    assert language.identify(docs(spark, []), model).count() == 0


def test_sample_of_many_languages_and_copies(spark):
    free = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(free[2 * k + j], f"wort{k} sprache{j} " * 20, f"l{k:03d}") for k in range(300) for j in range(2)]
    rows += [(free[700], "a text of which there are very many copies " * 4, "hot")] * 3000
    df = spark.createDataFrame([(i, t, y, "s", None, 1.0, "v") for i, t, y in rows], DOCS)
    found = language.sample(df, 5000, 5000)
    assert {y for _, y in found} == {f"l{k:03d}" for k in range(300)} | {"hot"}
    assert sum(y == "hot" for _, y in found) == 2          # the windows of one text


def test_quality_sample_goes_by_texts(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["all", "the", "click", "here", "!!!", "words", "of"]) for _ in range(rng.randint(9, 60)))
             for _ in range(900)]
    plain = docs(spark, list(enumerate(texts)))
    unnumbered = docs(spark, [(None if k % 3 == 0 else 7, t) for k, t in enumerate(texts)]).repartition(7)
    a, b = (quality.fit(df, 300)[1].weights for df in (plain, unnumbered))
    assert np.array_equal(a, b)                            # whatever the numbers and the order


# ---------------------------------------------------------------- pieces

def every_segmentation(p, text):
    s = pieces.MARK + text.replace(pieces.MARK, pieces.OWN_MARK).replace(" ", pieces.MARK)
    paths = [[(0.0, ())]] + [[] for _ in s]
    for a, b, ids, score in p.edges(s):
        paths[b] += [(v + score, x + ids) for v, x in paths[a]]
    return sorted(paths[-1], key=lambda x: -x[0])


def test_n_best_like_enumeration():
    rng = random.Random(1)
    encoder = pieces.Encoder(pieces.MODEL, 5)
    for _ in range(80):
        text = "".join(rng.choice("ab et.\né ▁9") for _ in range(rng.randint(1, 9)))
        want = every_segmentation(encoder.pieces, text)
        ids, score, others = next(encoder.encode([text]))
        got = [(score, tuple(ids.tolist()))]
        for s, edits in others:
            x = ids.tolist()
            for a, b, new in reversed(edits):
                x[a:b] = new
            got.append((s, tuple(x)))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:5]])
        assert len({x for _, x in got}) == len(got) and {x for _, x in got} <= {x for _, x in want}
        assert all(decoded(encoder.pieces, x) == text for _, x in got)


def decoded(p, ids):
    return p.decode(pieces._ids([np.array(ids, np.int32)])).to_pylist()[0].decode()[1:]


@pytest.mark.parametrize("letters, size", [("a", 14), ("-", 14), ("=", 13), (" ", 14), ("ab", 12), ("-=", 12), ("é", 9), ("\n", 12)])
def test_n_best_with_ties_like_enumeration(letters, size):
    rng = random.Random(size)
    p = pieces.Pieces(pieces.MODEL)
    for k in range(1, size + 1):
        text = "".join(rng.choice(letters) for _ in range(k))
        for s in p.lattices(text):
            paths = [[(0.0, ())]] + [[] for _ in s]
            for a, b, ids, score in p.edges(s):
                paths[b] += [(v + score, x + ids) for v, x in paths[a]]
            want = sorted(paths[-1], key=lambda x: (-x[0], x[1]))
            for n in (1, 2, 4, 7):
                assert p.n_best(s, n) == want[:n]


def test_long_runs_of_one_character():
    encoder = pieces.Encoder(pieces.MODEL, 4)
    for c in ("-", "=", "a", " ", "_-", "ab"):
        text = c * (20_000 // len(c))
        start = time.process_time()
        ids, score, others = next(encoder.encode([text]))
        assert time.process_time() - start < 6         # a search that doubles with each character never ends
        assert decoded(encoder.pieces, ids) == text and len(others) == 3
        assert all(s <= score for s, _ in others)


def test_round_trip(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "▁x ▁"), (6, "﷐\n\t\0é😀漢字"), (7, "a" * 3000),
            (8, "word " * 40000), (9, "x"), (9, "x")]
    encoded = pieces.encode(docs(spark, rows))
    assert encoded.where("doc_id = 1 and ids is null").count() == 1
    got = sorted((r.doc_id, r.text) for r in pieces.decode(encoded).collect())
    assert got == sorted(rows)
    real = table(spark, "/root/testdata/sf0.001", "documents")
    back = pieces.decode(pieces.encode(real)).withColumnRenamed("text", "back").join(real, "doc_id")
    assert back.where("back = text").count() == real.count()


# ---------------------------------------------------------------- vectors

def test_vectors_like_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = [list(map(float, c + rng.normal(size=16) * s)) for c in centres for s in (0.05, 0.15, 0.25, 0.4, 0.3)]
    x += [x[3], x[3], [v * 7 for v in x[3]], None, [], [0.0] * 16, [float("nan")] + x[0][1:], [None] + x[0][1:],
          [float("inf")] + x[0][1:], [1e-200 * v for v in x[5]], x[0][:8]]
    rows = [(i, v) for i, v in enumerate(x)] + [(2, x[2])]
    got = embeddings.near_duplicates(spark.createDataFrame(
        [(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, node long, n long")).collect()

    def ok(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    def linked(a, b):
        if not ok(a) or not ok(b) or len(a) != len(b):
            return False
        a, b = (np.array(v) / max(map(abs, v)) for v in (a, b))
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    n = len(rows)
    near = [[j for j in range(n) if j != i and linked(rows[i][1], rows[j][1])] for i in range(n)]
    comp = [i for i, _ in rows]
    while (new := [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]) != comp:
        comp = new
    want = sorted((i, len(m), c, i == c) for (i, _), m, c in zip(rows, near, comp))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_crowded_list_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(3)
    x = (np.ones(8) + rng.normal(size=(300, 8)) * 0.01).tolist()
    got = embeddings.near_duplicates(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"))
    assert [tuple(r) for r in got.select("n_links", "component_id").distinct().collect()] == [(299, 0)]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- quality

def test_label_model_finds_rates_and_scorer_follows(spark):
    rng = np.random.default_rng(0)
    bad = rng.random(20000) < 0.2
    rate = [(0.8, 0.01), (0.6, 0.05), (0.7, 0.02)]
    votes = ["".join("-" if rng.random() < r[0 if b else 1] else "0" for r in rate) for b in bad]
    counts = {v: votes.count(v) for v in set(votes)}
    model = quality.LabelModel(counts)
    assert abs(model.share - 0.2) < 0.03
    assert np.allclose(model.rates[1][:, 0], [0.8, 0.6, 0.7], atol=0.05)
    assert np.allclose(model.rates[0][:, 0], [0.01, 0.05, 0.02], atol=0.03)


def test_quality_against_labels(spark):
    rows, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.classify(rows, quality.fit(rows)).join(labels, "doc_id").toPandas()
    good = got[got.quality == 1]
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.93 and (good.score >= 0.5).mean() > 0.97
    edge = [(1, None), (2, ""), (3, "x"), (3, "x"), (4, "A clean sentence, with words. " * 9000)]
    out = {r.doc_id: r for r in quality.classify(docs(spark, edge), quality.fit(rows)).collect()}
    assert out[1].score == out[2].score and out[1].votes[5] == "-" and len(out) == 4
    assert quality.fit(docs(spark, [])) is None and quality.classify(docs(spark, [(1, "x")]), None).first().score == 0.5


def test_the_query_decodes_what_it_encodes(spark, tmp_path):
    texts = [None, "", " two  spaces ", "▁ own mark 😀\n", "the words", "the words"]
    docs(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pieces.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) and all(r.exact for r in got.values())
    assert {i: r.decoded_sha256 for i, r in got.items()} == {
        i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


# ---------------------------------------------------------------- archives

def test_archive_round_trip(spark, tmp_path):
    texts = [None, "", "é" * 9000, "é" * 9000, "a\r\n\r\nb\r\n0\r\n\r\n", "WARC/1.1\r\n\r\n", "x" * 999, "zz", "zz"]
    rows = [(i, f"http://x/\r\n{i}", t, "k") for i, t in enumerate(texts)] + [(8, None, "zz", "k"), (None, "u", "zz", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    path = str(tmp_path / "w")
    warc.write(pages, path, segment=700)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    by = {(r.page, r.kind) for r in got}
    assert by == {("0", "revisit"), ("1", "response"), ("2", "revisit"), ("3", "response"), ("4", "response"),
                  ("5", "response"), ("6", "response"), ("7", "revisit"), ("8", "response"), (None, "revisit")}
    payload = {r.page: r.payload for r in got if r.kind == "response"}
    assert all(payload[str(i)] == (texts[i] or "").encode() for i in (1, 3, 4, 5, 6, 8))
    names = {r.name: r.page for r in got}
    assert {names[r.refers_to] for r in got if r.kind == "revisit"} == {"1", "3", "8"}
    warc.write(pages.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("min_revisit", [0, 10 ** 6])
def test_repeated_long_pages_are_records_of_their_own(spark, tmp_path, min_revisit):
    long, other = "é" * 3000, "x" * 4000
    rows = [(1, "u", long), (7, "u", long), (7, "u", long), (7, "v", long), (1, "u", long), (None, "u", long),
            (None, "w", other), (None, "w", other), (3, "u", "short"), (3, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), segment=700, min_revisit=min_revisit)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) == len({r.name for r in got}) and all(r.problem is None for r in got)
    kinds = sorted((str(r.page), r.kind) for r in got)
    if min_revisit:
        assert {k for _, k in kinds} == {"response"}
    else:
        assert kinds == sorted([("1", "revisit")] * 2 + [("7", "response")] * 3 + [("None", "revisit")]
                               + [("None", "response")] * 2 + [("3", "response")] * 2)
    text = {None: other, "3": "short"}
    assert all(r.payload.decode() in (long, text.get(r.page)) for r in got if r.kind == "response")
    names = {r.name: r for r in got}
    assert all(names[r.refers_to].payload.decode() == long for r in got if r.kind == "revisit")


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                  "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), min_revisit=3)
    assert sorted((r.page, r.kind) for r in warc.read(spark, str(tmp_path / "w")).collect()) == [
        ("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_broken_archives_are_told(spark, tmp_path):
    parts = list(warc.records(1, "u", b"p" * 3000, 1, 500))
    (tmp_path / "a").mkdir()
    close = warc.CLOSE.encode()
    (tmp_path / "a" / "lost.warc").write_bytes(b"".join(r + close for k, r in enumerate(parts) if k != 3))
    (tmp_path / "a" / "orphan.warc").write_bytes(list(warc.records(2, "u", b"q" * 3000, 2, 500))[1] + close)
    whole = list(warc.records(3, "u", b"r" * 100, 3, 500))[0]
    (tmp_path / "a" / "cut.warc").write_bytes(whole + close + whole[:-20])
    (tmp_path / "a" / "odd.warc").write_bytes(b"no archive")
    got = warc.read(spark, str(tmp_path / "a")).collect()
    good = [r for r in got if r.problem is None]
    assert [(r.page, r.payload) for r in good] == [("3", b"r" * 100)]
    assert sorted(r.problem.split(":")[0].split(" ")[0] for r in got if r.problem) == ["byte", "byte", "continuations", "segments"]


def test_chunks():
    for n in (0, 1, 8192, 8193, 20000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
