"""The corpus pipeline against plain Python, stage by stage, and its table contract."""

import random
import re
import time

import duckdb

import corpus_pipeline
from ixpanel.llm import decontaminate, language, pieces, pii
from ixpanel.llm.common import table
from test_text_search import brute_components, brute_fingerprint, brute_hits, brute_pii

SF = "/root/testdata/sf0.001"


def masked(t):
    spans = []
    for k, a, b in brute_pii(t):
        if spans and a < spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], b)
        else:
            spans.append([k, a, b])
    for k, a, b in reversed(spans):
        t = t[:a] + f"<{k.upper()}>" + t[b:]
    return t


def test_pipeline_like_plain_python(spark, tmp_path):
    docs = table(spark, SF, "documents")
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    columns, before = docs.columns, docs.toPandas()
    model = language.learn(docs)
    lang = language.identify(docs, model).toPandas().set_index("doc_id")
    keep = {}
    rows = [r for r in before.itertuples() if lang.lang_pred[r.doc_id] != "und"
            and lang.score[r.doc_id] >= corpus_pipeline.MIN_SHARE]
    keep["language_id"] = {r.doc_id: r.text for r in rows}
    comp = brute_components([r.doc_id for r in rows], [brute_fingerprint(r.text) for r in rows])
    rows = [r for r, c in zip(rows, comp) if r.doc_id == c]
    keep["simhash_near_dedup"] = {r.doc_id: r.text for r in rows}
    vocab = {w for _, t in bench for w in re.findall(r"\w+", t.lower())}
    rows = [r for r in rows if len(set(re.findall(r"\w+", r.text.lower())) & vocab) < 4
            or not brute_hits(r.text, bench)[1]]
    keep["benchmark_decontamination"] = {r.doc_id: r.text for r in rows}
    keep["pii_redaction"] = {r.doc_id: masked(r.text) for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name in keep:
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == keep[name], name
    back = {r.doc_id: r.text for r in pieces.decode(docs).collect()}
    assert back == keep["pii_redaction"]


def test_pipeline_of_odd_tables(spark):
    schema = table(spark, SF, "documents").schema
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0
    rows = [(None, "the words of a row without a number", None, None, None), (2, None, None, None, None),
            (3, "", "en", "s", 0), (5, "same text of two", "en", "s", 3), (4, "same text of two", "en", "s", 3),
            (4, "same text of two", "en", "s", 3)]
    odd = spark.createDataFrame(rows, schema)
    by = dict(corpus_pipeline.STAGES)
    assert sorted(str(r.doc_id) for r in by["language_id"](spark, odd, SF).collect()) == ["4", "4", "5", "None"]
    assert sorted(str(r.doc_id) for r in by["simhash_near_dedup"](spark, odd, SF).collect()) == ["2", "4", "None"]
    assert by["benchmark_decontamination"](spark, odd, SF).count() == 6
    clash = odd.selectExpr("*", "doc_id as every", "text as base", "1 as key", "2 as row")
    out = by["pii_redaction"](spark, clash, SF)
    assert out.columns == clash.columns and out.where("not every <=> doc_id or row != 2").count() == 0
    assert by["sentencepiece_encoding"](spark, odd, SF).count() == 6


def test_each_row_goes_by_its_own_decision(spark, tmp_path):
    """Null and repeated numbers neither keep a row nor take another one with them."""
    schema = table(spark, SF, "documents").schema
    rng = random.Random(7)
    other = lambda: " ".join(rng.choice(["all", "of", "the", "words", "in", "this", "and", "that"]) + str(k) for k in range(40))
    a, b, c = (other() for _ in range(3))
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    got = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    by = dict(corpus_pipeline.STAGES)
    english = "the words of a row and the text that it has"
    rows = [(None, "?! 12"), (None, english), (4, "..."), (4, english)]
    assert got(by["language_id"](spark, make(rows), SF)) == [("4", english), ("None", english)]
    rows = [(None, a), (2, a), (None, b), (None, b), (2, c), (1, c), (1, c), (1, c)]
    assert got(by["simhash_near_dedup"](spark, make(rows), SF)) == sorted([("2", a), ("None", b), ("1", c)])
    spark.createDataFrame([(None, "a secret of an item without a number"), (1, "zz yy xx")],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "so zz yy xx"), (None, "clean"), (4, "zz yy xx"), (4, "clean"), (5, "A secret of an item without a number")]
    assert got(by["benchmark_decontamination"](spark, make(rows), str(tmp_path))) == [("4", "clean"), ("None", "clean")]


def test_many_spans_in_a_text(spark):
    """Redaction is linear in the spans; overlapping ones go as one, across blocks too."""
    rng = random.Random(3)
    rows, want = [], []
    for n in (0, 1, 5, 63, 64, 65, 130, 300):
        text = "".join(rng.choice("ab é\U0001f600") for _ in range(5 * n + 3))
        spans = sorted((a, 0, rng.choice(["email", "ctx_phone"]), min(len(text), a + rng.choice([1, 2, 9, 40])))
                       for a in rng.sample(range(len(text)), n))
        out, reach = "", 0
        for a, _, kind, b in spans:
            if a >= reach:
                out += text[reach:a] + f"<{kind.replace('ctx_', '').upper()}>"
            reach = max(reach, b)
        rows.append((n, text, spans))
        want.append((n, out + text[reach:]))
    df = spark.createDataFrame(rows, "n int, text string, every array<struct<start: bigint, rank: bigint, kind: string, end: bigint>>")
    assert sorted(tuple(r) for r in df.select("n", pii.redacted().alias("t")).collect()) == want
    mail = " and ".join(f"user{k}@example.org" for k in range(20_000))
    one = spark.createDataFrame([(1, mail)], "doc_id long, text string")
    start = time.time()
    got = corpus_pipeline.pii_redaction(spark, one, SF).first().text
    assert got == " and ".join(["<EMAIL>"] * 20_000) and time.time() - start < 60


def test_items_without_a_number_contaminate_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame([(None, "zz yy xx"), (1, "zz yy xx"), (None, "ww vv"), (None, "ww vv")],
                          "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "so zz yy xx"), (2, "ww vv ww vv"), (3, "clean")],
                          "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(decontaminate.SQL).fetchall())
    assert sorted(tuple(r) for r in decontaminate.query(spark, str(tmp_path)).collect()) == want
    assert [r[5] for r in want] == [True, True, False]
