"""Workbook files → cells (S1, S2 edge); S8 sinks.

This is the edge of ingest: the cells are stored once (``sources/cells.py``)
and queries read that table. The ``binaryFile`` source lists and loads
workbooks (one file per row; files are not split, and a task's input is
bounded by ``spark.sql.files.maxPartitionBytes``); ``mapInPandas`` decodes
each one with the standard library (``zipfile`` + ``xml.etree``) into long
cells and yields them in chunks, so a large sheet never sits in memory as one
frame. Only plain values are read — no styles beyond date detection, no
formulas' evaluation, no merged ranges (see README).
"""

from __future__ import annotations

import datetime as _dt
import io
import os
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_SCHEMA = ("file string, sheet string, sheet_pos int, r_raw int, r int, c int, "
               "raw string, kind string")

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "rel": "http://schemas.openxmlformats.org/package/2006/relationships"}
_M = "{%s}" % _NS["m"]
# --- fixed values: built-in number formats that show dates or times ---
_DATE_FMT_IDS = set(range(14, 23)) | {45, 46, 47}
_CHUNK = 50_000
ERROR = "error"         # kind of the row of a file that can't be read


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _number_text(v: str) -> str:
    """``str()`` of the value a spreadsheet reader gives for a number cell."""
    if any(ch in v for ch in ".eE"):
        return str(float(v))
    try:
        return str(int(v))
    except ValueError:
        return str(float(v))


def _excel_date(v: str) -> str:
    base = _dt.datetime(1899, 12, 30)
    return str(base + _dt.timedelta(days=float(v)))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Style indexes whose number format is a date."""
    try:
        root = ET.fromstring(z.read("xl/styles.xml"))
    except KeyError:
        return set()
    custom = {}
    for nf in root.iter(_M + "numFmt"):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", nf.get("formatCode", "")).lower()
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code))
    out = set()
    xfs = root.find(_M + "cellXfs")
    if xfs is not None:
        for i, xf in enumerate(xfs.findall(_M + "xf")):
            fid = int(xf.get("numFmtId", "0"))
            if fid in _DATE_FMT_IDS or custom.get(fid, False):
                out.add(i)
    return out


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    try:
        root = ET.fromstring(z.read("xl/sharedStrings.xml"))
    except KeyError:
        return []
    return ["".join(t.text or "" for t in si.iter(_M + "t")) for si in root.findall(_M + "si")]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.findall("rel:Relationship", _NS)}
    out = []
    for s in wb.find(_M + "sheets").findall(_M + "sheet"):
        rid = s.get("{%s}id" % _NS["r"])
        t = target[rid].lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else "xl/" + t))
    return out


def iter_workbook_cells(name: str, content: bytes):
    """Yield lists of cell tuples ``(sheet, sheet_pos, r_raw, r, c, raw, kind)``.

    Rows are stored in ascending order, so the compacted row number ``r``
    (rank among rows with at least one value) is kept as a running count."""
    z = zipfile.ZipFile(io.BytesIO(content))
    strings = _shared_strings(z)
    dates = _date_styles(z)
    for pos, (sheet, part) in enumerate(_sheets(z)):
        buf = []
        row_no = -1
        last_row, r = None, -1
        with z.open(part) as fh:
            for _, el in ET.iterparse(fh):
                if el.tag == _M + "row":
                    el.clear()
                    continue
                if el.tag != _M + "c":
                    continue
                ref = el.get("r") or ""
                m = re.match(r"([A-Za-z]+)(\d+)", ref)
                if m:
                    c, row_no = _col_index(m.group(1)), int(m.group(2)) - 1
                else:
                    raise ValueError(f"sheet {sheet!r}: a cell without a reference")
                t = el.get("t", "n")
                v = el.find(_M + "v")
                val = None if v is None else v.text
                if t == "inlineStr":
                    is_ = el.find(_M + "is")
                    raw = None if is_ is None else "".join(x.text or "" for x in is_.iter(_M + "t"))
                    kind = "s"
                elif val is None:
                    raw, kind = None, None
                elif t == "s":
                    raw, kind = strings[int(val)], "s"
                elif t in ("str", "e"):
                    raw, kind = val, "s"
                elif t == "b":
                    raw, kind = ("True" if val.strip() == "1" else "False"), "b"
                elif t == "d":
                    raw, kind = str(_dt.datetime.fromisoformat(val)), "d"
                elif int(el.get("s", "0")) in dates:
                    raw, kind = _excel_date(val), "d"
                else:
                    raw, kind = _number_text(val), "n"
                el.clear()
                if raw is None:
                    continue
                if row_no != last_row:
                    last_row, r = row_no, r + 1
                buf.append((sheet, pos, row_no, r, c, raw, kind))
                if len(buf) >= _CHUNK:
                    yield buf
                    buf = []
        if buf:
            yield buf


def _decode(batches):
    cols = ["sheet", "sheet_pos", "r_raw", "r", "c", "raw", "kind"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            name = os.path.basename(path)
            try:        # all of a workbook or nothing; it is in memory anyway
                chunks = list(iter_workbook_cells(name, content))
            except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, OSError) as e:
                chunks = [[(None, -1, -1, -1, -1, repr(e), ERROR)]]
            for chunk in chunks:
                df = pd.DataFrame(chunk, columns=cols)
                df.insert(0, "file", name)
                for k in ("sheet_pos", "r_raw", "r", "c"):
                    df[k] = df[k].astype("int32")
                yield df


def decoded(files: DataFrame) -> DataFrame:
    """Cells of ``files`` (path, content); a file that can't be read gives one row of kind ERROR."""
    return files.select("path", "content").mapInPandas(_decode, CELL_SCHEMA)


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def read_cells(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """S1/S2 edge: every sheet of every workbook in the folder ``path`` (not below it, so names
    are unique) as cells; files that can't be read have none (``unreadable`` names them)."""
    return decoded(_files(spark, path, glob)).filter(F.col("kind") != ERROR)


def unreadable(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """``file, problem`` of the workbooks that can't be read."""
    return decoded(_files(spark, path, glob)).filter(F.col("kind") == ERROR).select("file", F.col("raw").alias("problem"))


# ---------------------------------------------------------------- sinks

def records_out(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a result (Parquet, or JSON lines keeping null fields absent)."""
    w = df.write.mode("overwrite")
    if fmt == "json":
        w.option("ignoreNullFields", "true").json(path)
    else:
        w.parquet(path)


def to_json_records(df: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """One JSON text per row (nulls kept as ``null`` or left out)."""
    opts = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.to_json(F.struct(*df.columns), opts).alias("record"))
