"""Workbook files for tests: one per ``file`` of a cell table, written by the test itself."""

import io
import os
import zipfile

import pandas as pd

from ixpanel.sources.workbook import _NS


def _xml_escape(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            .replace('"', "&quot;"))


def _col_ref(c: int) -> str:
    s = ""
    c += 1
    while c:
        c, rem = divmod(c - 1, 26)
        s = chr(65 + rem) + s
    return s


def workbook_bytes(cells: pd.DataFrame) -> bytes:
    """One workbook from the cells of one file (inline strings, no styles)."""
    sheets = (cells[["sheet_pos", "sheet"]].drop_duplicates().sort_values("sheet_pos"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        ct = ['<?xml version="1.0" encoding="UTF-8"?>',
              '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">',
              '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>',
              '<Default Extension="xml" ContentType="application/xml"/>',
              '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>']
        wb = ['<?xml version="1.0" encoding="UTF-8"?>',
              f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_NS["r"]}"><sheets>']
        rels = ['<?xml version="1.0" encoding="UTF-8"?>', f'<Relationships xmlns="{_NS["rel"]}">']
        for i, (pos, name) in enumerate(zip(sheets["sheet_pos"], sheets["sheet"]), start=1):
            ct.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType='
                      '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            wb.append(f'<sheet name="{_xml_escape(name)}" sheetId="{i}" r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/'
                        f'officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>')
            sc = cells[cells["sheet_pos"] == pos].sort_values(["r_raw", "c"])
            body = [f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>']
            for r_raw, grp in sc.groupby("r_raw", sort=True):
                body.append(f'<row r="{int(r_raw) + 1}">')
                for c, raw, kind in zip(grp["c"], grp["raw"], grp["kind"]):
                    ref = f"{_col_ref(int(c))}{int(r_raw) + 1}"
                    if kind == "n":
                        body.append(f'<c r="{ref}"><v>{raw}</v></c>')
                    elif kind == "b":
                        body.append(f'<c r="{ref}" t="b"><v>{1 if raw == "True" else 0}</v></c>')
                    elif kind == "d":
                        body.append(f'<c r="{ref}" t="d"><v>{raw.replace(" ", "T")}</v></c>')
                    else:
                        body.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">'
                                    f'{_xml_escape(raw)}</t></is></c>')
                body.append("</row>")
            body.append("</sheetData></worksheet>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", "".join(body))
        ct.append("</Types>")
        wb.append("</sheets></workbook>")
        rels.append("</Relationships>")
        z.writestr("[Content_Types].xml", "".join(ct))
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?>'
                   f'<Relationships xmlns="{_NS["rel"]}"><Relationship Id="rId1" Type='
                   '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"'
                   ' Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", "".join(wb))
        z.writestr("xl/_rels/workbook.xml.rels", "".join(rels))
    return out.getvalue()


def write_workbooks(cells, out_dir):
    """Write the workbooks of a (small) cell table into a folder."""
    os.makedirs(out_dir, exist_ok=True)
    for name, group in cells.toPandas().groupby("file"):
        with open(os.path.join(out_dir, name), "wb") as fh:
            fh.write(workbook_bytes(group))
