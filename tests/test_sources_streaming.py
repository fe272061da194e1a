"""Workbook source, skew-safe ranking, streaming ingest."""

import os
import tempfile
import zipfile

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from ixpanel.operators import grids as G
from ixpanel.operators.ranking import rank_within
from ixpanel.plans import views as V
from ixpanel.sources import files as FS
from ixpanel.sources import workbook as WB
from ixpanel.streaming import ingest as ST

from conftest import SF_SMALL
from workbook_writer import write_workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def hand_made_workbook(path):
    """A workbook as spreadsheet programs write it: shared strings, a date
    style, a boolean, a blank row, two sheets."""
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} {rel}><sheets>'
                   '<sheet name="Data" sheetId="1" r:id="rId1"/>'
                   '<sheet name="Notes" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="x" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Type="x" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {NS}><si><t>Year</t></si><si><t>Jan</t></si>'
                   '<si><r><t>Fe</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs count="2"><xf numFmtId="0"/>'
                   '<xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData>'
                   '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
                   '<c r="C1" t="s"><v>2</v></c></row>'
                   '<row r="3"><c r="A3"><v>2024</v></c><c r="B3"><v>308.4</v></c>'
                   '<c r="C3"><v>1E3</v></c><c r="D3" t="b"><v>1</v></c>'
                   '<c r="E3" s="1"><v>45474</v></c><c r="F3" s="1"/></row>'
                   '</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData>'
                   '<row r="2"><c r="B2" t="inlineStr"><is><t>note</t></is></c></row>'
                   '</sheetData></worksheet>')


def test_read_hand_made_workbook(spark):
    d = tempfile.mkdtemp(prefix="wb-")
    hand_made_workbook(os.path.join(d, "book.xlsx"))
    cells = WB.read_cells(spark, d)
    got = sorted(tuple(r) for r in cells.collect())
    assert got == sorted([
        ("book.xlsx", "Data", 0, 0, 0, 0, "Year", "s"), ("book.xlsx", "Data", 0, 0, 0, 1, "Jan", "s"),
        ("book.xlsx", "Data", 0, 0, 0, 2, "Feb", "s"),
        ("book.xlsx", "Data", 0, 2, 1, 0, "2024", "n"), ("book.xlsx", "Data", 0, 2, 1, 1, "308.4", "n"),
        ("book.xlsx", "Data", 0, 2, 1, 2, "1000.0", "n"), ("book.xlsx", "Data", 0, 2, 1, 3, "True", "b"),
        ("book.xlsx", "Data", 0, 2, 1, 4, "2024-07-01 00:00:00", "d"),
        ("book.xlsx", "Notes", 1, 1, 0, 1, "note", "s")])
    pts = G.year_month_unpivot(cells).collect()
    assert sorted((p.year, p.month, p.value) for p in pts) == [(2024, 1, 308.4), (2024, 2, 1000.0)]


def test_write_read_round_trip(spark):
    cells = V.points_cells(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="wb-rt-")
    write_workbooks(cells, out)
    back = WB.read_cells(spark, out)
    cols = ["file", "sheet", "sheet_pos", "r_raw", "r", "c", "raw", "kind"]
    assert sorted(map(tuple, cells.select(cols).collect())) == sorted(map(tuple, back.collect()))


def test_json_records_sink(spark):
    df = spark.createDataFrame([("a", None, 1.5)], "category string, x double, y double")
    assert WB.to_json_records(df).first().record == '{"category":"a","y":1.5}'
    assert WB.to_json_records(df, keep_nulls=True).first().record == '{"category":"a","x":null,"y":1.5}'


def test_rank_within_matches_window_under_skew(spark):
    # one page holds half of all rows
    df = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("page_id"),
        (F.col("id") % 3).alias("priority"), F.col("id").alias("pos"))
    got = rank_within(df, ["page_id"], [F.col("priority"), F.desc("pos")], num_partitions=8)
    w = Window.partitionBy("page_id").orderBy(F.col("priority"), F.desc("pos"))
    want = df.withColumn("rank", F.row_number().over(w))
    a = sorted(map(tuple, got.select("page_id", "pos", "rank").collect()))
    b = sorted(map(tuple, want.select("page_id", "pos", "rank").collect()))
    assert a == b
    # the hot page is spread over several range partitions
    parts = df.repartitionByRange(8, "page_id", "priority", F.desc("pos")) \
              .withColumn("p", F.spark_partition_id()).filter("page_id = 7").select("p").distinct().count()
    assert parts > 1


def test_stream_ingest_and_latest(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    panel = V.panel(spark, SF_SMALL)
    panel.withColumn("y", F.substring("date", 1, 4)).repartition("y").drop("y") \
         .write.parquet(f"{root}/drop")
    q = ST.stream_latest(spark, f"{root}/drop", f"{root}/table", f"{root}/latest", f"{root}/ckpt",
                         n=2, max_files_per_trigger=1)
    q.awaitTermination()
    table = ST.read_table(spark, f"{root}/table")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, panel.collect()))
    latest = ST.read_latest(spark, f"{root}/latest")
    top = sorted({r.date for r in panel.select("date").collect()})[-2:]
    assert sorted({r.date for r in latest.collect()}) == top
    # a second pass over the same folder finds nothing new (the checkpoint remembers)
    q2 = ST.stream_ingest(spark, f"{root}/drop", f"{root}/table2", f"{root}/ckpt")
    q2.awaitTermination()
    assert not os.path.exists(f"{root}/table2")


def test_scan_directory_lists_workbooks_only(spark):
    from ixpanel.sources import files as FS
    d = tempfile.mkdtemp(prefix="dir-")
    hand_made_workbook(os.path.join(d, "b.xlsx"))
    hand_made_workbook(os.path.join(d, "a.xlsx"))
    with open(os.path.join(d, "notes.xls"), "wb") as fh:
        fh.write(b"x")
    m = FS.scan_directory(spark, d)
    got = sorted((r.file, r.size) for r in m.collect())
    assert got == sorted((f, os.path.getsize(os.path.join(d, f))) for f in ("a.xlsx", "b.xlsx"))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]   # file bodies are not read for a listing
    assert FS.latest_file(m).count() == 1


def test_broken_workbooks_are_told_and_folders_stay_apart(spark, tmp_path):
    from ixpanel.sources import workbook as WB
    (tmp_path / "sub").mkdir()
    cells = spark.createDataFrame([("book.xlsx", "S", 0, 0, 0, 0, "in the folder", "s")], WB.CELL_SCHEMA)
    other = spark.createDataFrame([("book.xlsx", "S", 0, 0, 0, 0, "below it", "s")], WB.CELL_SCHEMA)
    write_workbooks(cells, str(tmp_path))
    write_workbooks(other, str(tmp_path / "sub"))
    (tmp_path / "~$book.xlsx").write_bytes(b"lock")
    assert [r.raw for r in WB.read_cells(spark, str(tmp_path)).collect()] == ["in the folder"]
    bad = WB.unreadable(spark, str(tmp_path)).collect()
    assert [r.file for r in bad] == ["~$book.xlsx"] and "BadZipFile" in bad[0].problem
    assert {r.file for r in FS.scan_directory(spark, str(tmp_path)).collect()} == {"book.xlsx", "~$book.xlsx"}


def test_cells_without_references_are_rejected(spark, tmp_path):
    import zipfile
    from ixpanel.sources import workbook as WB
    cells = spark.createDataFrame([("book.xlsx", "S", 0, 0, 0, 0, "x", "s")], WB.CELL_SCHEMA)
    write_workbooks(cells, str(tmp_path / "made"))
    (tmp_path / "bare").mkdir()
    with zipfile.ZipFile(tmp_path / "made" / "book.xlsx") as old, \
            zipfile.ZipFile(tmp_path / "bare" / "book.xlsx", "w") as new:
        for n in old.namelist():
            new.writestr(n, old.read(n).replace(b' r="A1"', b""))
    assert WB.read_cells(spark, str(tmp_path / "bare")).count() == 0
    assert "reference" in WB.unreadable(spark, str(tmp_path / "bare")).first().problem


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    from types import SimpleNamespace
    from ixpanel import session
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(bare)
    path = session.scratch_path(spark, "gone")
    spark.range(1).write.parquet(path)
    session.remove_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        session.remove_scratch(spark, "/tmp/elsewhere")


def published(spark, rows):
    return spark.createDataFrame(rows, ST.PUBLISHED_SCHEMA + ", source string")


def ts(day):
    import datetime
    return datetime.datetime(2024, 1, day)


def test_upsert_keeps_the_newest_publication(spark, tmp_path):
    t = str(tmp_path / "t")
    assert ST.read_table(spark, t).count() == 0
    ST.upsert(published(spark, [("a", "2024-01", 1.0, "nsa", ts(5), "x"), ("b", "2024-01", 2.0, "nsa", ts(5), "x"),
                                ("a", "2024-02", 3.0, "nsa", ts(5), "x")]), 0, t)
    second = published(spark, [("a", "2024-01", 9.0, "nsa", ts(9), "y"), ("b", "2024-01", 8.0, "nsa", ts(1), "old"),
                               ("c", "2024-01", 7.0, "sa", ts(9), "y"), ("c", "2024-01", 6.0, "sa", ts(9), "a"),
                               ("d", None, 1.0, "sa", ts(9), "y"), ("d", "2024/01", 1.0, "sa", None, None)])
    want = {("a", "2024-01", 9.0, "nsa"), ("b", "2024-01", 2.0, "nsa"), ("c", "2024-01", 7.0, "sa"), ("a", "2024-02", 3.0, "nsa")}
    for _ in range(2):               # the batch again, as after a crash
        ST.upsert(second, 1, t)
        assert {tuple(r) for r in ST.read_table(spark, t).collect()} == want
    # Only the touched month was written; a version without its heads doesn't count.
    assert os.listdir(f"{t}/rows/version=1") != [] and not os.path.exists(f"{t}/rows/version=1/date=2024-02")
    os.makedirs(f"{t}/heads/v=2")
    assert {tuple(r) for r in ST.read_table(spark, t).collect()} == want
    ST.vacuum(spark, t)
    assert {tuple(r) for r in ST.read_table(spark, t).collect()} == want
    assert not os.path.exists(f"{t}/rows/version=0/date=2024-01") and os.path.exists(f"{t}/rows/version=0/date=2024-02")
    heads = ST._heads(spark, t).filter("date = '2024-02'")
    assert all("date=2024-02" in f for f in ST._rows_of(spark, t, heads).inputFiles())


def test_crash_between_the_sinks_and_a_bad_file(spark, tmp_path, monkeypatch):
    drop, out, ckpt = (str(tmp_path / x) for x in ("drop", "out", "ckpt"))
    grid = [("Year", 0, 0, "s"), ("Jan", 0, 1, "s"), ("2024", 1, 0, "n"), ("5", 1, 1, "n")]
    cells = spark.createDataFrame([(f, "S", 0, r, r, c, raw, kind) for f in ("a.xlsx", "b.xlsx") for raw, r, c, kind in grid],
                                  WB.CELL_SCHEMA)
    write_workbooks(cells, drop)
    (tmp_path / "drop" / "bad.xlsx").write_bytes(b"no workbook")
    sink, calls = ST._sink, []

    def failing(rows, folder, batch_id):
        calls.append(folder)
        if len(calls) == 2:
            raise RuntimeError("lost between the sinks")
        sink(rows, folder, batch_id)

    monkeypatch.setattr(ST, "_sink", failing)
    q = ST.stream_workbooks(spark, drop, out, ckpt)
    with pytest.raises(Exception, match="lost between the sinks"):
        q.awaitTermination()
    schema = "file string"
    assert os.path.exists(f"{out}/points/batch=0") and ST.read_committed(spark, out, "points", schema).count() == 0
    monkeypatch.setattr(ST, "_sink", sink)
    for _ in range(2):               # the restart, and one with nothing new
        ST.stream_workbooks(spark, drop, out, ckpt).awaitTermination()
        assert sorted((r.file, r.layout) for r in ST.read_committed(spark, out, "points").collect()) == [
            (f, k) for f in ("a.xlsx", "b.xlsx") for k in ("context", "year_month")]
        assert [r.file for r in ST.read_committed(spark, out, "unreadable").collect()] == ["bad.xlsx"]


def test_stored_cells_read_only_what_is_asked(spark, tmp_path):
    from ixpanel.sources import cells as SC
    cells = V.points_cells(spark, SF_SMALL)
    path = str(tmp_path / "cells")
    SC.write_cells(cells, path, parts=8)
    stored = SC.read_cells(spark, path)
    assert sorted(map(tuple, stored.select(cells.columns).collect())) == sorted(map(tuple, cells.collect()))
    latest = FS.latest_file(V.points_manifest(spark, SF_SMALL))
    one = SC.of_files(stored, latest, parts=8)
    file = latest.first().file
    assert one.count() == cells.filter(F.col("file") == file).count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan and "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    first = G.first_sheet(stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sheet_pos,0)" in first
    # Rows of a file lie together.
    assert all(len(os.listdir(os.path.join(path, p))) <= 4 for p in os.listdir(path) if p.startswith("part="))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_asof_join_like_search(spark, parts):
    import random
    from ixpanel.operators.asof import asof_join
    rng = random.Random(parts)
    left = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(40)])) for i in range(300)]
    right = [(rng.choice(["hot"] * 3 + ["a", "c", None]), rng.choice([None, *range(5, 40)]), f"f{rng.randrange(30)}") for _ in range(60)]
    l = spark.createDataFrame(left, "id int, g string, t int")
    r = spark.createDataFrame(right, "g string, t int, file string")
    got = {x.id: (x.at, x.file) for x in asof_join(
        l, r.withColumnRenamed("t", "at"), ["g"], "t", "at", ["at", "file"], parts).collect()}
    want = {i: max(((t2, f) for g2, t2, f in right if g2 == g and t is not None and t2 is not None and t2 <= t),
                   default=(None, None)) for i, g, t in left}
    assert got == want
    assert asof_join(l, r.filter("false").withColumnRenamed("t", "at"), ["g"], "t", "at", ["file"], parts).filter(
        "file is not null").count() == 0
    assert asof_join(l.filter("false"), r.withColumnRenamed("t", "at"), ["g"], "t", "at", ["file"], parts).count() == 0


def test_manifest_changes(spark):
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    schema = "file string, size long, mtime timestamp"
    old = spark.createDataFrame([("a.xlsx", 1, day(1)), ("b.xlsx", 1, day(1)), ("c.xlsx", 1, day(1)), ("d.xlsx", 1, None),
                                 ("n.xls", 1, day(1))], schema)
    new = spark.createDataFrame([("a.xlsx", 1, day(1)), ("b.xlsx", 2, day(1)), ("d.xlsx", 1, None), ("e.xlsx", 1, day(2))], schema)
    assert sorted((r.file, r.kind) for r in FS.changes(old, new).collect()) == [
        ("b.xlsx", "changed"), ("c.xlsx", "removed"), ("e.xlsx", "added")]
    three = old.selectExpr("1 as version", "*").unionByName(new.selectExpr("2 as version", "*")).unionByName(
        old.selectExpr("3 as version", "*")).filter("file like '%.xlsx'")
    kinds = sorted((r.version, r.file, r.kind) for r in FS.snapshot_changes(three).collect())
    assert [k for k in kinds if k[0] == 3] == [(3, "b.xlsx", "changed"), (3, "c.xlsx", "added"), (3, "e.xlsx", "removed")]
    assert [k for k in kinds if k[0] == 1] == [(1, f"{c}.xlsx", "added") for c in "abcd"] and not [k for k in kinds if k[0] > 3]


def test_rules_as_a_table(spark):
    from ixpanel.operators import links as LK
    a = spark.createDataFrame([(1, 0, "http://x/", "/a.xlsx", "CPI-U"), (1, 1, "http://x/", "/b.pdf", "index"), (1, 2, "http://x/", None, None)],
                              "page_id long, pos int, base string, href string, text string")
    rules = lambda rows: LK.rule_table(spark.createDataFrame(rows, "priority int, field string, pattern string"))
    got = lambda rows: {r.pos: r.priority for r in LK.workbook_links(a, "2024-01", rules(rows)).collect()}
    assert got([(5, "text", "."), (2, "href", "b[.]")]) == {0: 5, 1: 2}
    assert got([(5, "text", "^C")]) == {0: 5} and got([]) == {}
    assert {r.pos: r.priority for r in LK.workbook_links(a, "2024-01").collect()} == {0: 2}
    with pytest.raises(ValueError):
        rules([(1, "url", "x")])
    with pytest.raises(ValueError):
        rules([(i, "href", "x") for i in range(LK.MAX_RULES + 1)])
