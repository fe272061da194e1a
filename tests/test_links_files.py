"""Links (FIXTURES X7) and manifests."""

import datetime as dt

from pyspark.sql import functions as F

from ixpanel.operators import links as LK
from ixpanel.sources import files as FS
from ixpanel.sources import links as SL

BASE = "https://site.example/cpi/tables/"
X7_HTML = """<html><body><ul>
<li><a href="/cpi/tables/supplemental-files/cpi-u-202505.xlsx">CPI-U</a></li>
<li><a class="x" href="/cpi/tables/supplemental-files/cpi-u-202506.xlsx"> CPI-U </a></li>
<li><a href='/files/latest.xlsx'><b>CPI</b>-U</a></li>
<li><a href="/cpi/tables/supplemental-files/c-cpi-u-202506.xlsx">C-CPI-U</a></li>
<li><a href="/files/notes.pdf">CPI-U</a></li>
<li><a href="/files/ppi-202506.xlsx">PPI</a></li>
<li><a name="top">CPI-U</a></li>
<li><A HREF="https://other.example/cpi/u.xls">June 2024 index &amp; more</A></li>
</ul></body></html>"""


def x7_links(spark):
    pages = spark.createDataFrame([(1, BASE, X7_HTML)], "page_id long, url string, html string")
    return LK.workbook_links(SL.anchors(pages), "2025-07")


def test_anchor_extraction(spark):
    pages = spark.createDataFrame([(1, BASE, X7_HTML)], "page_id long, url string, html string")
    a = SL.anchors(pages).orderBy("pos").collect()
    assert len(a) == 7                      # the anchor without href is not kept
    assert a[2].text == "CPI-U"             # tags removed, pieces stripped and joined
    assert a[6].text == "June 2024 index & more"
    assert a[6].href == "https://other.example/cpi/u.xls"


def test_anchors_of_odd_markup(spark):
    html = ("<a-x href='/no1'>custom</a-x><!-- <a href='/no2'>hidden</a> --><script>'<a href=\"/no3\">'</script>"
            "<a href='/1'>one<a href='/2'>t&#119;o &amp;lt; &#x1F600;</a> <a\nhref=/3>caf&eacute;&#233;&#38;amp;</A >"
            "<a href='/4?a=1&amp;b=2'>open &#xD800; end")
    pages = spark.createDataFrame([(1, BASE, html), (2, BASE, None), (3, BASE, "no links")], "page_id long, url string, html string")
    got = [(r.href, r.text) for r in SL.anchors(pages).orderBy("page_id", "pos").collect()]
    assert got == [("/1", "one"), ("/2", "two &lt; \U0001f600"), ("/3", "caf\u00e9\u00e9&amp;"),
                   ("/4?a=1&b=2", "open \ufffd end")]


def test_x7_priority_date_rank(spark):
    links = x7_links(spark)
    got = {r.filename: (r.priority, r.date) for r in links.collect()}
    assert got == {"cpi-u-202505.xlsx": (1, "2025-05"), "cpi-u-202506.xlsx": (1, "2025-06"),
                   "latest.xlsx": (2, "2025-07"), "c-cpi-u-202506.xlsx": (1, "2025-06"),
                   "u.xls": (3, "2024-06")}
    ranked = [r.pos for r in LK.link_rank(links).orderBy("rank").collect()]
    # document positions (from 0) of anchors 2, 4, 1, 3, 8
    assert ranked == [1, 3, 0, 2, 7]
    url = {r.filename: r.url for r in links.collect()}
    assert url["latest.xlsx"] == "https://site.example/files/latest.xlsx"


def test_x7_targets(spark):
    links = x7_links(spark)
    for target, pos in [("2025-05", 0), ("2025-06", 1), ("2024-06", 7), ("2023-01", 1)]:
        assert LK.link_target(links, target).first().pos == pos, target


def x8(spark):
    rows = [("cpi-u-202504.xlsx", 10, dt.datetime(2025, 5, 15, 8)),
            ("cpi-u-202505.xlsx", 11, dt.datetime(2025, 6, 12, 8)),
            ("cpi-u-202506.xlsx", 12, dt.datetime(2025, 7, 15, 8)),
            ("notes.xls", 5, dt.datetime(2025, 7, 15, 9))]
    return spark.createDataFrame(rows, "file string, size long, mtime timestamp")


AS_OF = "2025-07-15 14:00:00"


def test_x8_manifest(spark):
    m = x8(spark)
    assert [r.file for r in FS.file_manifest(m).collect()] == \
        ["cpi-u-202506.xlsx", "cpi-u-202505.xlsx", "cpi-u-202504.xlsx"]
    assert FS.latest_file(m).first().file == "cpi-u-202506.xlsx"
    assert [r.file for r in FS.file_names_desc(m).collect()][0] == "cpi-u-202506.xlsx"
    wb = FS.workbooks(m)
    assert FS.fresh_files(wb, AS_OF, 6).filter("fresh").count() == 0      # exactly 6 h old
    assert [r.file for r in FS.fresh_files(wb, AS_OF, 24).filter("fresh").collect()] == ["cpi-u-202506.xlsx"]
    assert sorted(r.file for r in FS.retention(m, AS_OF, 30).collect()) == \
        ["cpi-u-202504.xlsx", "cpi-u-202505.xlsx"]
    known = m.filter(F.col("file").isin("cpi-u-202504.xlsx", "cpi-u-202505.xlsx"))
    assert [r.file for r in FS.new_files(m, known).collect()] == ["cpi-u-202506.xlsx"]


def test_latest_file_empty(spark):
    m = x8(spark).filter("false")
    assert FS.latest_file(m).count() == 0


def test_source_status(spark):
    m = x8(spark)
    cat = spark.createDataFrame([("cpi-u-202506.xlsx", "S", 6 + i, f"c{i}") for i in range(12)],
                                "file string, sheet string, r_raw int, category string")
    st = FS.source_status(m, cat).first()
    assert (st.n_files, st.latest_file, st.n_categories, st.data_available) == (3, "cpi-u-202506.xlsx", 12, True)
    assert st.sample_categories == ", ".join(f"c{i}" for i in range(10))
