import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ixpanel.session import build_session
    s = build_session("local[4]", app="ixpanel-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="ixpanel-test-ckpt-")})
    yield s
    s.stop()


def _kind(v):
    if isinstance(v, bool):
        return "b"
    if isinstance(v, (int, float)):
        return "n"
    if isinstance(v, dt.datetime):
        return "d"
    return "s"


def grid_cells(spark, grid, file="book.xlsx", sheet="Sheet1", sheet_pos=0, rows=None):
    """Cell table from a list of rows (``None`` = blank cell). ``rows`` gives
    the stored row number of each list entry (blank rows in between);
    ``r`` is the compacted row number."""
    rows = rows or list(range(len(grid)))
    out = []
    compact = 0
    for r_raw, row in zip(rows, grid):
        cells = [(c, v) for c, v in enumerate(row) if v is not None]
        if not cells:
            continue
        for c, v in cells:
            out.append((file, sheet, sheet_pos, r_raw, compact, c, str(v), _kind(v)))
        compact += 1
    return spark.createDataFrame(
        out, "file string, sheet string, sheet_pos int, r_raw int, r int, c int, raw string, kind string")


@pytest.fixture(scope="session")
def x1_rows():
    """Supplemental sheet of FIXTURES X1 (rows 0, 3, 4, 6, 7, 9, 10)."""
    grid = [
        ["Table 7. CPI-U"],
        ["Indent level", "Expenditure category", "Relative importance", "Unadjusted indexes",
         "Unadjusted indexes", "Seasonally adjusted indexes", "Seasonally adjusted indexes",
         "Unadjusted percent change"],
        [None, None, None, "May\n2025", "Jun.\n2025", "May\n2025", "Jun.\n2025", "May 2025-\nJun. 2025"],
        [0, "All items", 100.0, 320.58, 321.465, 320.58, 321.5, 0.3],
        [1, "Food", 13.6, 338.0, 339.5, "-", 339.9, 0.4],
        [1, " Energy ", 6.2, "1,275.4", "1,280.1", "N/A", 281.0, 0.4],
        [2, "Food", 8.0, 1, 2, 3, 4, 5],
    ]
    return grid, [0, 3, 4, 6, 7, 9, 10]
