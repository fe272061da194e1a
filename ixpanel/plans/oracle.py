"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement re-derives its input view from the raw driver tables in plain
SQL and computes the expected answer *without* going through the Spark
operators: the grid queries, for example, compute the values the rendered
sheets should give back, so a wrong header map or parser cannot pass.
"""

from __future__ import annotations

# ---------------------------------------------------------------- shared CTEs

PANEL_WIDE = """
panel_wide AS (
  SELECT concat_ws('/', p_brand, CAST(p_size AS VARCHAR), p_type) AS category, strftime(l_shipdate, '%Y-%m') AS date,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS nsa,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS sa
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2)"""

PANEL = PANEL_WIDE + """,
panel AS (
  SELECT category, date, CAST(nsa AS DOUBLE) AS "index", 'nsa' AS adjustment FROM panel_wide
  UNION ALL
  SELECT category, date, CAST(sa AS DOUBLE) AS "index", 'sa' AS adjustment FROM panel_wide)"""


def prev_month_sql(ym: str) -> str:
    return f"strftime(CAST({ym} || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')"


def pct_sql(cur: str, prev: str) -> str:
    return (f"round_even(((({cur}) - ({prev})) / nullif({prev}, 0) * 100.0) * 100.0, 0) / 100.0")


SQL: dict[str, str] = {}

SQL["mom_change"] = f"""
WITH {PANEL},
l AS (
  SELECT category, date, "index", adjustment,
         lag(date) OVER w AS ld, lag("index") OVER w AS li
  FROM panel WINDOW w AS (PARTITION BY category, adjustment ORDER BY date)),
p AS (
  SELECT category, date, "index", adjustment,
         CASE WHEN ld = {prev_month_sql('date')} THEN li END AS prev_index
  FROM l)
SELECT category, date, "index", adjustment, prev_index,
       {pct_sql('"index"', 'prev_index')} AS mom_change_pct
FROM p
"""

SQL["panel_sort"] = f"""
WITH {PANEL}
SELECT category, date, "index", adjustment FROM panel ORDER BY category, date, adjustment
"""

SQL["panel_profile"] = f"""
WITH {PANEL}
SELECT count(*) AS n_rows, count(DISTINCT category) AS n_categories,
       min(date) AS first_date, max(date) AS last_date,
       string_agg(DISTINCT adjustment, ',' ORDER BY adjustment) AS adjustments
FROM panel
"""


# ---------------------------------------------------------------- rendered sheets
# Expected values of the supplemental sheets rendered from the panel: month m
# holds each category of m in name order, with m-1 and m values; every cell
# hit by the placeholder rule reads back as null. The layout v follows the
# month: h is the header row, o the columns' shift, nc and sc the first column
# of each pair. v = 3 isn't found; v = 4 has no adjusted columns (they fall
# back); v = 7 labels only the first column of each pair; in v = 2 the header
# is below row 6, so its text is a label too.

def _ph(c: str, col: str) -> str:
    return f"CASE WHEN (r_raw * 3 + {c} + mord) % 7 = 0 THEN NULL ELSE CAST({col} AS DOUBLE) END"


LAYOUT = """CAST([3, 0, 10, 11, 3, 3, 3, 3][mord % 8 + 1] AS INTEGER) AS h, CASE WHEN mord % 8 = 5 THEN 1 ELSE 0 END AS o,
         CAST(CASE mord % 8 WHEN 6 THEN 5 WHEN 5 THEN 4 ELSE 3 END AS INTEGER) AS nc,
         CAST(CASE mord % 8 WHEN 6 THEN 3 WHEN 5 THEN 6 ELSE 5 END AS INTEGER) AS sc, mord % 8 AS v"""

SHEETS = PANEL_WIDE + f""",
months AS (
  SELECT date, file, 'Table 7' AS sheet, {LAYOUT}, mord
  FROM (SELECT DISTINCT date, 'cpi-u-' || replace(date, '-', '') || '.xlsx' AS file,
               CAST(substr(date, 1, 4) AS INTEGER) * 12 + CAST(substr(date, 6, 2) AS INTEGER) AS mord FROM panel_wide)),
sheet AS (
  SELECT cur.category, m.*,
         CAST(row_number() OVER (PARTITION BY cur.date ORDER BY cur.category) - 1 + greatest(6, m.h + 3) AS INTEGER) AS r_raw,
         {prev_month_sql('cur.date')} AS prev_date,
         cur.nsa AS nsa_cur, cur.sa AS sa_cur, prev.nsa AS nsa_prev, prev.sa AS sa_prev
  FROM panel_wide cur JOIN months m USING (date) LEFT JOIN panel_wide prev
    ON prev.category = cur.category AND prev.date = {prev_month_sql('cur.date')}),
sheet_nsa AS (
  SELECT *, {_ph('nc', 'nsa_prev')} AS nsa_previous,
         CASE WHEN v <> 7 THEN {_ph('(nc + 1)', 'nsa_cur')} END AS nsa_current
  FROM sheet WHERE v <> 3),
sheet_vals AS (
  SELECT file, sheet, date AS current_month, prev_date AS previous_month, category AS label, r_raw,
         nsa_previous, nsa_current,
         CASE WHEN v = 4 THEN nsa_previous ELSE {_ph('sc', 'sa_prev')} END AS sa_previous,
         CASE WHEN v = 4 THEN nsa_current WHEN v <> 7 THEN {_ph('(sc + 1)', 'sa_cur')} END AS sa_current
  FROM sheet_nsa
  UNION ALL
  SELECT file, sheet, date, {prev_month_sql('date')}, 'Expenditure category', h, NULL, NULL, NULL, NULL
  FROM months WHERE v = 2),
catalogue AS (
  SELECT file, sheet, r_raw, CASE WHEN v = 5 THEN '1' ELSE category END AS category FROM sheet
  UNION ALL SELECT file, sheet, h, 'Expenditure category' FROM months WHERE v IN (2, 3))"""

SQL["header_row"] = f"WITH {SHEETS} SELECT file, sheet, h AS header_r FROM months WHERE v <> 3"

SQL["category_column"] = f"WITH {SHEETS} SELECT file, sheet, CAST(1 + o AS INTEGER) AS cat_c FROM months WHERE v <> 3"

SQL["column_map"] = f"""
WITH {SHEETS}
SELECT file, sheet, date AS current_month, nc AS c_nsa_previous, CASE WHEN v <> 7 THEN nc + 1 END AS c_nsa_current,
       CASE WHEN v <> 4 THEN sc END AS c_sa_previous, CASE WHEN v NOT IN (4, 7) THEN sc + 1 END AS c_sa_current
FROM months WHERE v <> 3
"""

SQL["sheet_records"] = f"""
WITH {SHEETS}
SELECT file, sheet, current_month, label, r_raw, nsa_previous, nsa_current, sa_previous, sa_current
FROM sheet_vals
"""

SQL["sheet_long"] = f"""
WITH {SHEETS},
st AS (
  SELECT file, label AS category, previous_month AS date, nsa_previous AS "index", 'nsa' AS adjustment FROM sheet_vals
  UNION ALL SELECT file, label, current_month, nsa_current, 'nsa' FROM sheet_vals
  UNION ALL SELECT file, label, previous_month, sa_previous, 'sa' FROM sheet_vals
  UNION ALL SELECT file, label, current_month, sa_current, 'sa' FROM sheet_vals)
SELECT file, category, date, "index", adjustment FROM st
WHERE "index" IS NOT NULL AND NOT isnan("index")
"""

SQL["sa_fallback"] = f"""
WITH {SHEETS}       -- no column counts as adjusted
SELECT file, label, current_month, nsa_previous, nsa_current,
       nsa_previous AS sa_previous, nsa_current AS sa_current
FROM sheet_vals
"""

SQL["category_catalogue"] = f"""
WITH {SHEETS}
SELECT file, sheet, r_raw, category FROM catalogue
"""

# ---------------------------------------------------------------- requests

REQUESTS = """
kinds AS (SELECT p_partkey, concat_ws('/', p_brand, CAST(p_size AS VARCHAR), p_type) AS c1 FROM part),
req AS (
  SELECT o_orderkey AS request_id,
         concat_ws(',', c1, ' ' || c2 || ' ', CASE WHEN o_orderkey % 5 = 0 THEN c1 END,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'Brand#99' END,
                   CASE WHEN o_orderkey % 11 = 0 THEN ' ' END) AS categories,
         CASE WHEN o_orderkey % 50 = 7 THEN strftime(o_orderdate, '%Y') || '-' || CAST(month(o_orderdate) AS VARCHAR)
              WHEN o_orderkey % 50 = 13 THEN strftime(o_orderdate, '%Y') || '-13'
              ELSE strftime(o_orderdate, '%Y-%m') END AS date
  FROM orders LEFT JOIN kinds k1 ON k1.p_partkey = o_orderkey % 200
  LEFT JOIN (SELECT p_partkey, c1 AS c2 FROM kinds) k2 ON k2.p_partkey = (o_orderkey * 7 + 3) % 20000),
chk0 AS (
  SELECT request_id, categories, date,
         list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: x <> '') AS lst
  FROM req),
chk AS (
  SELECT request_id, date, lst, CAST(len(lst) AS INTEGER) AS n_categories,
         CASE WHEN NOT coalesce(regexp_matches(date, '^[0-9]{4}-(1[0-2]|0[1-9]|[1-9])$'), false)
                THEN 'date must be YYYY-MM'
              WHEN len(lst) < 1 THEN 'at least one category must be specified' END AS reason
  FROM chk0),
ex0 AS (
  SELECT request_id, date, unnest(lst) AS ticker, CAST(unnest(range(0, len(lst))) AS INTEGER) AS ord
  FROM chk WHERE reason IS NULL),
ex AS (
  SELECT request_id, date, ticker, ord,
         strftime(make_date(CAST(split_part(date, '-', 1) AS INTEGER),
                            CAST(split_part(date, '-', 2) AS INTEGER), 1), '%Y-%m') AS current_month,
         strftime(make_date(CAST(split_part(date, '-', 1) AS INTEGER),
                            CAST(split_part(date, '-', 2) AS INTEGER), 1) - INTERVAL 1 MONTH, '%Y-%m')
           AS previous_month
  FROM ex0)"""

BATCH = SHEETS + "," + REQUESTS + """,
wide AS (
  SELECT ex.request_id, ex.ord, ex.ticker AS category, ex.current_month, ex.previous_month,
         sv.nsa_previous, sv.nsa_current, sv.sa_previous, sv.sa_current
  FROM ex JOIN sheet_vals sv ON sv.current_month = ex.current_month AND sv.label = ex.ticker),
long0 AS (
  SELECT request_id, ord, category, previous_month AS date, nsa_previous AS "index", 'nsa' AS adjustment FROM wide
  UNION ALL SELECT request_id, ord, category, current_month, nsa_current, 'nsa' FROM wide
  UNION ALL SELECT request_id, ord, category, previous_month, sa_previous, 'sa' FROM wide
  UNION ALL SELECT request_id, ord, category, current_month, sa_current, 'sa' FROM wide),
long AS (SELECT * FROM long0 WHERE "index" IS NOT NULL AND NOT isnan("index"))"""

SQL["request_valid"] = f"""
WITH {REQUESTS}
SELECT request_id, date, n_categories, reason IS NULL AS valid, reason FROM chk
"""

SQL["category_list"] = f"""
WITH {REQUESTS}
SELECT request_id, CAST(unnest(range(0, len(lst))) AS INTEGER) AS ord, unnest(lst) AS category FROM chk
"""

SQL["month_shift"] = f"""
WITH {REQUESTS}
SELECT request_id, date,
       CASE WHEN coalesce(regexp_matches(date, '^[0-9]{{4}}-(1[0-2]|0[1-9]|[1-9])$'), false) THEN
         strftime(make_date(CAST(split_part(date, '-', 1) AS INTEGER),
                            CAST(split_part(date, '-', 2) AS INTEGER), 1), '%Y-%m') END AS current_month,
       CASE WHEN coalesce(regexp_matches(date, '^[0-9]{{4}}-(1[0-2]|0[1-9]|[1-9])$'), false) THEN
         strftime(make_date(CAST(split_part(date, '-', 1) AS INTEGER),
                            CAST(split_part(date, '-', 2) AS INTEGER), 1) - INTERVAL 1 MONTH, '%Y-%m') END
         AS previous_month
FROM req
"""

SQL["category_lookup"] = f"""
WITH {BATCH}
SELECT ex.request_id, ex.ord, ex.ticker, sv.file, sv.r_raw
FROM ex JOIN sheet_vals sv ON sv.file = 'cpi-u-' || replace(ex.current_month, '-', '') || '.xlsx'
                          AND sv.label = ex.ticker
"""

SQL["wide_record"] = f"WITH {BATCH} SELECT * FROM wide"

SQL["month_labelled"] = f"""
WITH {BATCH}
SELECT request_id, ord, category, current_month, previous_month,
       nsa_previous AS nsa_previous_month, nsa_current AS nsa_current_month,
       sa_previous AS sa_previous_month, sa_current AS sa_current_month
FROM wide
"""

SQL["long_format"] = f"WITH {BATCH} SELECT * FROM long"

SQL["batch_requests"] = f"WITH {BATCH} SELECT * FROM long ORDER BY category, date, adjustment, request_id, ord"

SQL["mom_change_wide"] = f"""
WITH {BATCH}
SELECT *, {pct_sql('nsa_current', 'nsa_previous')} AS nsa_mom_change_pct,
          {pct_sql('sa_current', 'sa_previous')} AS sa_mom_change_pct
FROM wide
"""

SQL["missing_categories"] = f"""
WITH {BATCH}
SELECT ex.request_id, ex.ord, ex.ticker FROM ex
WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.request_id = ex.request_id AND w.ord = ex.ord)
"""

SQL["coverage"] = f"""
WITH {BATCH},
fw AS (SELECT request_id, count(*) AS found_wide FROM wide GROUP BY 1),
fl AS (SELECT request_id, count(DISTINCT category) AS found_long FROM long GROUP BY 1),
j AS (
  SELECT c.request_id, c.date, c.n_categories AS requested,
         coalesce(fw.found_wide, 0) AS found_wide, coalesce(fl.found_long, 0) AS found_long
  FROM chk c LEFT JOIN fw USING (request_id) LEFT JOIN fl USING (request_id)
  WHERE c.reason IS NULL)
SELECT request_id, date, requested,
       found_wide, requested - found_wide AS failed_wide, found_wide > 0 AS success_wide,
       CASE WHEN found_wide > 0 THEN 'Successfully loaded data for ' || found_wide || ' categories'
            ELSE 'No data found for the specified categories and date ' || date END AS message_wide,
       found_long, requested - found_long AS failed_long, found_long > 0 AS success_long,
       CASE WHEN found_long > 0 THEN 'Successfully loaded data for ' || found_long || ' categoriesin long format'
            ELSE 'No data found for the specified categories and date ' || date END AS message_long
FROM j
"""


# ---------------------------------------------------------------- other layouts
# Suppliers' workbooks: sheet "grid" (shipments, Year × month, years shown
# later) and sheet "series" (monthly value). By supplier k: header rows h4 and
# h5, shift o, columns dc, vc and sc, years moved by sh.

POINTS = """
lm AS (
  SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS ms, count(*) AS n,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS v
  FROM lineitem GROUP BY ALL),
bk AS (
  SELECT k, 'supplier-' || k || '.xlsx' AS file, CAST([1, 11, 0, 10, 3][k % 5 + 1] AS INTEGER) AS h4,
         CAST([0, 2, 10, 9][k % 4 + 1] AS INTEGER) AS h5, CAST(k % 3 AS INTEGER) AS o,
         CASE WHEN k % 6 = 5 THEN 20 ELSE 25 END AS sh, CAST([0, 2, 1][k % 3 + 1] AS INTEGER) AS dc,
         CAST([1, 0, 2][k % 3 + 1] AS INTEGER) AS vc, CAST([2, 1, 0][k % 3 + 1] AS INTEGER) AS sc
  FROM (SELECT DISTINCT k FROM lm)),
pyears AS (
  SELECT k, file, h4, o, y, CAST(y + sh AS INTEGER) AS yshow, annual,
         CAST(h4 + row_number() OVER (PARTITION BY k ORDER BY y) AS INTEGER) AS r
  FROM (SELECT k, year(ms) AS y, sum(n) AS annual FROM lm GROUP BY ALL) JOIN bk USING (k)),
gcell AS (
  SELECT file, h4, r, CAST(o + month(ms) AS INTEGER) AS c, yshow, CAST(month(ms) AS INTEGER) AS month,
         CAST(n AS DOUBLE) AS value
  FROM lm JOIN pyears ON pyears.k = lm.k AND y = year(ms)),
srows AS (
  SELECT bk.*, ms, v, CAST(h5 + row_number() OVER (PARTITION BY k ORDER BY ms) AS INTEGER) AS r,
         CASE WHEN month(ms) = 3 THEN strftime(ms, '%Y') || 'M03'
              WHEN month(ms) % 6 = 0 THEN strftime(ms, '%b %Y')
              WHEN month(ms) % 5 = 0 THEN strftime(ms, '%Y-%m-%d 00:00:00')
              ELSE strftime(ms, '%Y-%m') END AS date_text,
         CASE WHEN k % 5 <> 0 AND month(ms) % 4 <> 0
              THEN 'SUP' || k || CASE WHEN k % 3 = 1 THEN 'NSA' ELSE 'SA' END END AS code
  FROM lm JOIN bk USING (k)),
g4 AS (
  SELECT file, 'grid' AS sheet, 'year_month' AS layout, r, c, 'cpi' AS ticker, yshow AS year, month,
         value, 'CPI_U_CPI' AS series_id, 'Consumer Price Index (CPI-U)' AS category,
         'bls_excel' AS source, true AS seasonally_adjusted
  FROM gcell WHERE h4 <= 10),
g5 AS (
  SELECT file, 'series' AS sheet, 'timeseries' AS layout, r, vc AS c, 'cpi' AS ticker,
         CAST(year(ms) AS INTEGER) AS year, CAST(month(ms) AS INTEGER) AS month, CAST(v AS DOUBLE) AS value,
         CASE WHEN k % 5 = 0 THEN '' ELSE coalesce(code, 'CPI_U_CPI') END AS series_id,
         'Consumer Price Index (CPI-U)' AS category, 'bls_excel' AS source,
         NOT coalesce(contains(code, 'NSA'), false) AS seasonally_adjusted
  FROM srows WHERE h5 <= 9 AND month(ms) NOT IN (3, 9)),
g6 AS (
  SELECT file, 'grid' AS sheet, 'context' AS layout, r, c, 'cpi' AS ticker, yshow AS year, month,
         value, 'CPI_U_CPI' AS series_id, 'Consumer Price Index (CPI-U)' AS category,
         'bls_excel' AS source, true AS seasonally_adjusted
  FROM gcell WHERE h4 <= 4 AND yshow BETWEEN 2020 AND 2030),
g8 AS (SELECT * FROM g4 UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6)"""

SQL["year_month_unpivot"] = f"WITH {POINTS} SELECT * FROM g4"
SQL["timeseries_extract"] = f"WITH {POINTS} SELECT * FROM g5"
SQL["context_extract"] = f"WITH {POINTS} SELECT * FROM g6"
SQL["union_layouts"] = f"WITH {POINTS} SELECT * FROM g8"

SQL["year_month_context"] = f"""
WITH {POINTS},
top AS (SELECT k, min(yshow) AS first_year FROM pyears WHERE yshow BETWEEN 2020 AND 2030 GROUP BY k)
SELECT file, 'grid' AS sheet, r, c, value, CASE WHEN yshow BETWEEN 2020 AND 2030 THEN yshow END AS year,
       CASE WHEN h4 <= 4 THEN month END AS month FROM gcell
UNION ALL
SELECT file, 'grid', r, o, CAST(yshow AS DOUBLE), CASE WHEN yshow BETWEEN 2020 AND 2030 THEN yshow ELSE first_year END,
       CAST(NULL AS INTEGER) FROM pyears LEFT JOIN top USING (k)
UNION ALL
SELECT file, 'grid', r, CAST(o + 13 AS INTEGER), CAST(annual AS DOUBLE),
       CASE WHEN yshow BETWEEN 2020 AND 2030 THEN yshow END, CAST(NULL AS INTEGER) FROM pyears
UNION ALL
SELECT file, 'series', r, vc, CAST(v AS DOUBLE), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER)
FROM srows WHERE month(ms) <> 9
"""

SQL["recent_periods"] = f"""
WITH {POINTS},
per AS (SELECT DISTINCT file, year, month FROM g8 WHERE year <> 0 AND month <> 0),
top AS (SELECT file, year, month FROM (
          SELECT *, row_number() OVER (PARTITION BY file ORDER BY year DESC, month DESC) AS k FROM per)
        WHERE k <= 2)
SELECT g8.* FROM g8 SEMI JOIN top USING (file, year, month)
"""

SQL["layout_stats"] = f"""
WITH {POINTS}
SELECT file, sheet, layout, count(*) AS n_points,
       count(DISTINCT CAST(year AS VARCHAR) || '-' || CAST(month AS VARCHAR)) AS n_periods
FROM g8 GROUP BY ALL
"""

SQL["latest_points"] = f"""
WITH {POINTS},
man AS (SELECT 'supplier-' || l_suppkey || '.xlsx' AS file, max(l_shipdate) AS mtime FROM lineitem GROUP BY ALL),
latest AS (SELECT file FROM man ORDER BY mtime DESC, file DESC LIMIT 1),
pts AS (SELECT * FROM g8 WHERE file IN (SELECT file FROM latest) AND year <> 0 AND month <> 0),
top AS (SELECT DISTINCT year, month FROM pts ORDER BY year DESC, month DESC LIMIT 2)
SELECT pts.*, CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period
FROM pts SEMI JOIN top USING (year, month)
"""

SQL["parse_period"] = f"""
WITH {POINTS}
SELECT file, r, date_text AS raw, CASE WHEN month(ms) <> 3 THEN CAST(year(ms) AS INTEGER) END AS year,
       CASE WHEN month(ms) <> 3 THEN CAST(month(ms) AS INTEGER) END AS month
FROM srows WHERE h5 <= 9
"""

SQL["seasonal_flag"] = f"""
WITH {POINTS}
SELECT file, r, code AS raw, NOT contains(code, 'NSA') AS seasonally_adjusted
FROM srows WHERE h5 <= 9 AND code IS NOT NULL
"""

SQL["four_digit_year"] = f"""
WITH {POINTS}
SELECT file, 'grid' AS sheet, r, o AS c, yshow AS year FROM pyears WHERE yshow BETWEEN 2020 AND 2030
UNION ALL
SELECT file, 'grid', r, c, CAST(value AS INTEGER) FROM gcell WHERE value BETWEEN 2020 AND 2030
UNION ALL
SELECT file, 'grid', r, CAST(o + 13 AS INTEGER), CAST(annual AS INTEGER) FROM pyears
WHERE annual BETWEEN 2020 AND 2030
"""

# ---------------------------------------------------------------- numbers

MESSY = """
mn AS (
  SELECT event_id, event_type AS category, event_id % 8 AS st, CAST(value AS DECIMAL(12,2)) AS dec
  FROM events),
mv AS (
  SELECT event_id, category, st,
         CASE st WHEN 0 THEN CAST(dec AS VARCHAR)
                 WHEN 1 THEN printf('%,.2f', dec * 1000)
                 WHEN 2 THEN CAST(dec AS VARCHAR) || '%'
                 WHEN 3 THEN CASE WHEN event_id % 16 = 11 THEN chr(160) || CAST(dec AS VARCHAR)
                                  ELSE ' ' || CAST(dec AS VARCHAR) || chr(9) END
                 WHEN 4 THEN '-' WHEN 5 THEN 'N/A' WHEN 6 THEN 'nan'
                 ELSE 'x' || CAST(dec AS VARCHAR) END AS raw,
         CASE WHEN st IN (0, 2, 3) THEN dec WHEN st = 1 THEN dec * 1000 END AS dval
  FROM mn)"""

SQL["clean_numeric"] = f"WITH {MESSY} SELECT event_id, raw, CAST(dval AS DOUBLE) AS value FROM mv"

SQL["is_numeric"] = f"""WITH {MESSY}
SELECT event_id, st IN (0, 3, 6) OR (st = 1 AND dval < 1000) AS numeric FROM mv"""

SQL["numeric_quality"] = f"""
WITH {MESSY}
SELECT category, count(*) AS n_cells, count(dval) AS n_parsed,
       count(*) FILTER (WHERE st IN (4, 5, 6)) AS n_placeholder,
       count(*) FILTER (WHERE st = 7) AS n_unparsable,
       CAST(sum(CAST(dval AS DECIMAL(18,2))) AS DOUBLE) AS sum_parsed
FROM mv GROUP BY category
"""

# ---------------------------------------------------------------- files

MANIFEST = """
mo AS (
  SELECT date_trunc('month', o_orderdate) AS ms, count(*) AS size, max(o_orderdate) AS last
  FROM orders GROUP BY 1),
manifest AS (
  SELECT 'cpi-u-' || strftime(ms, '%Y%m') || '.xlsx' AS file, size, last + INTERVAL 8 HOUR AS mtime FROM mo
  UNION ALL
  SELECT 'notes-' || strftime(ms, '%Y%m') || '.xls', size, last + INTERVAL 9 HOUR FROM mo
  WHERE month(ms) % 4 = 0),
wb AS (SELECT * FROM manifest WHERE lower(file) LIKE '%.xlsx')"""

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
AS_OF = "TIMESTAMP '2001-08-01 20:00:00'"

SQL["file_manifest"] = f"WITH {MANIFEST} SELECT file, size, {TS.format(c='mtime')} AS mtime FROM wb ORDER BY mtime DESC, file DESC"
SQL["latest_file"] = f"""WITH {MANIFEST}
SELECT file, {TS.format(c='mtime')} AS mtime FROM wb ORDER BY mtime DESC, file DESC LIMIT 1"""
SQL["file_names_desc"] = f"WITH {MANIFEST} SELECT file FROM wb ORDER BY file DESC"
SQL["new_files"] = f"""WITH {MANIFEST}
SELECT file, size, {TS.format(c='mtime')} AS mtime FROM wb
WHERE file NOT IN (SELECT file FROM manifest WHERE mtime < TIMESTAMP '2001-06-01 00:00:00')"""
SQL["fresh_files"] = f"""WITH {MANIFEST}
SELECT file, {TS.format(c='mtime')} AS mtime, mtime > {AS_OF} - INTERVAL 6 HOUR AS fresh_download,
       mtime > {AS_OF} - INTERVAL 24 HOUR AS fresh_serve FROM manifest"""
SQL["retention"] = f"""WITH {MANIFEST}
SELECT file, {TS.format(c='mtime')} AS mtime, 'delete' AS action FROM wb WHERE mtime < {AS_OF} - INTERVAL 30 DAY"""

SQL["file_info"] = """
SELECT 'supplier-' || l_suppkey || '.xlsx' AS file, 'grid,series' AS sheets, CAST(2 AS BIGINT) AS n_sheets,
       count(*) AS size, strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS mtime
FROM lineitem GROUP BY l_suppkey
"""

SQL["source_status"] = f"""
WITH {MANIFEST}, {SHEETS},
head AS (SELECT count(*) AS n_files, max(mtime) AS mx, arg_max(file, mtime) AS f0 FROM wb),
lat AS (SELECT file, mtime FROM wb ORDER BY mtime DESC, file DESC LIMIT 1),
cat AS (SELECT file, count(*) AS n_categories,
               string_agg(category, ', ' ORDER BY r_raw) FILTER (WHERE r_raw < 16) AS sample_categories
        FROM catalogue GROUP BY file)
SELECT head.n_files, lat.file AS latest_file, {TS.format(c='lat.mtime')} AS latest_mtime,
       coalesce(cat.n_categories, 0) AS n_categories, cat.sample_categories,
       lat.file IS NOT NULL AS data_available
FROM head LEFT JOIN lat ON true LEFT JOIN cat ON cat.file = lat.file
"""


LATEST = """
newest AS (SELECT file, substr(file, 7, 4) || '-' || substr(file, 11, 2) AS m FROM wb
           ORDER BY mtime DESC, file DESC LIMIT 1),
lat AS (SELECT sv.*, n.m AS cur, sv.previous_month AS prev FROM newest n JOIN sheet_vals sv ON sv.file = n.file),
wide_latest AS (
  SELECT ex.request_id, ex.ord, ex.ticker AS category, ex.current_month, ex.previous_month,
         CASE ex.previous_month WHEN lat.cur THEN nsa_current WHEN lat.prev THEN nsa_previous END AS nsa_previous,
         CASE ex.current_month WHEN lat.cur THEN nsa_current WHEN lat.prev THEN nsa_previous END AS nsa_current,
         CASE ex.previous_month WHEN lat.cur THEN sa_current WHEN lat.prev THEN sa_previous END AS sa_previous,
         CASE ex.current_month WHEN lat.cur THEN sa_current WHEN lat.prev THEN sa_previous END AS sa_current
  FROM ex JOIN lat ON lat.label = ex.ticker)"""

SQL["wide_record_latest"] = f"WITH {MANIFEST}, {BATCH}, {LATEST} SELECT * FROM wide_latest"

SQL["missing_categories_latest"] = f"""
WITH {MANIFEST}, {BATCH}, {LATEST}
SELECT ex.request_id, ex.ord, ex.ticker FROM ex
WHERE NOT EXISTS (SELECT 1 FROM wide_latest w WHERE w.request_id = ex.request_id AND w.ord = ex.ord)
"""

SQL["coverage_latest"] = f"""
WITH {MANIFEST}, {BATCH}, {LATEST},
fw AS (SELECT request_id, count(*) AS found_wide,
              count(DISTINCT category) FILTER (WHERE nsa_previous IS NOT NULL OR nsa_current IS NOT NULL
                OR sa_previous IS NOT NULL OR sa_current IS NOT NULL) AS found_long
       FROM wide_latest GROUP BY 1),
j AS (
  SELECT c.request_id, c.date, c.n_categories AS requested,
         coalesce(fw.found_wide, 0) AS found_wide, coalesce(fw.found_long, 0) AS found_long
  FROM chk c LEFT JOIN fw USING (request_id) WHERE c.reason IS NULL)
SELECT request_id, date, requested,
       found_wide, requested - found_wide AS failed_wide, found_wide > 0 AS success_wide,
       CASE WHEN found_wide > 0 THEN 'Successfully loaded data for ' || found_wide || ' categories'
            ELSE 'No data found for the specified categories and date ' || date END AS message_wide,
       found_long, requested - found_long AS failed_long, found_long > 0 AS success_long,
       CASE WHEN found_long > 0 THEN 'Successfully loaded data for ' || found_long || ' categoriesin long format'
            ELSE 'No data found for the specified categories and date ' || date END AS message_long
FROM j
"""


# ---------------------------------------------------------------- links

ORIGIN = r"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"
FNAME = r"string_split(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1), '/')[-1]"

PAGE_LINKS = r"""
pa AS (
  SELECT page_id, url AS base, unnest(arr) AS a, CAST(unnest(range(0, len(arr))) AS INTEGER) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS arr FROM pages)),
pt AS (
  SELECT page_id, pos, base, regexp_extract(a, '(?is)^<a\b([^>]*)>', 1) AS tag,
         regexp_extract(a, '(?is)^<a\b[^>]*>(.*)</a>$', 1) AS inr
  FROM pa),
ph AS (
  SELECT page_id, pos, base, inr,
         CASE WHEN regexp_matches(tag, '(?is)(^|\s)href\s*=\s*"') THEN regexp_extract(tag, '(?is)(?:^|\s)href\s*=\s*"([^"]*)"', 1)
              WHEN regexp_matches(tag, '(?is)(^|\s)href\s*=\s*''') THEN regexp_extract(tag, '(?is)(?:^|\s)href\s*=\s*''([^'']*)''', 1)
         END AS href0
  FROM pt),
pl AS (
  SELECT page_id, pos, base,
         replace(replace(replace(href0, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href,
         array_to_string(list_filter(list_transform(regexp_split_to_array(
             replace(replace(replace(inr, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '<[^>]*>'),
             lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '') AS text
  FROM ph WHERE href0 IS NOT NULL)"""

SQL["listing_links"] = f"""
WITH {PAGE_LINKS},
r AS (
  SELECT page_id, pos, href, text,
         CASE WHEN href LIKE 'http%' THEN href
              WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN {ORIGIN.format(b='base')} || href
         END AS url
  FROM pl)
SELECT page_id, pos, href, text, url, {FNAME.format(u='url')} AS filename FROM r
"""

LISTING = r"""
lk0 AS (
  SELECT o_custkey AS page_id, o_orderkey AS pos, o_orderkey % 4 AS s, o_orderdate AS od, o_orderkey AS k
  FROM orders),
lk AS (
  SELECT page_id, pos,
         CASE s WHEN 0 THEN '/cpi/tables/supplemental-files/cpi-u-' || strftime(od, '%Y%m') || '.xlsx'
                WHEN 1 THEN '/files/latest-' || CAST(k AS VARCHAR) || '.xlsx'
                WHEN 2 THEN 'https://other.example/cpi/data/' || lower(strftime(od, '%B')) || '-'
                            || strftime(od, '%Y') || '.xls'
                ELSE '/files/report-' || CAST(k AS VARCHAR) || '.pdf' END AS href,
         CASE WHEN s = 2 THEN strftime(od, '%B') || ' ' || strftime(od, '%Y') || ' index'
              ELSE 'CPI-U' END AS text
  FROM lk0),
lr AS (
  SELECT page_id, pos, href, text,
         CASE WHEN href LIKE 'http%' THEN href ELSE 'https://site.example' || href END AS url
  FROM lk),
lf AS (SELECT *, string_split(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1), '/')[-1]
                 AS filename FROM lr),
ld AS (
  SELECT *, lower(text || ' ' || filename) AS t FROM lf),
ld2 AS (
  SELECT *,
    regexp_extract(t, '(\w+)\s+(\d{4})', 1) AS w1, regexp_extract(t, '(\w+)\s+(\d{4})', 2) AS y1,
    regexp_extract(t, '(\d{4})-(\d{2})', 0) AS m2, regexp_extract(t, '(\d{4})(\d{2})', 0) AS m3
  FROM ld),
ld3 AS (
  SELECT *, CASE w1 WHEN 'january' THEN '01' WHEN 'jan' THEN '01' WHEN 'february' THEN '02'
                    WHEN 'feb' THEN '02' WHEN 'march' THEN '03' WHEN 'mar' THEN '03'
                    WHEN 'april' THEN '04' WHEN 'apr' THEN '04' WHEN 'may' THEN '05'
                    WHEN 'june' THEN '06' WHEN 'jun' THEN '06' WHEN 'july' THEN '07' WHEN 'jul' THEN '07'
                    WHEN 'august' THEN '08' WHEN 'aug' THEN '08' WHEN 'september' THEN '09'
                    WHEN 'sep' THEN '09' WHEN 'sept' THEN '09' WHEN 'october' THEN '10' WHEN 'oct' THEN '10'
                    WHEN 'november' THEN '11' WHEN 'nov' THEN '11' WHEN 'december' THEN '12'
                    WHEN 'dec' THEN '12' END AS mm1
  FROM ld2),
links_all AS (
  SELECT page_id, pos, href, text, url, filename,
         coalesce(CASE WHEN y1 <> '' AND mm1 IS NOT NULL THEN y1 || '-' || mm1 END,
                  CASE WHEN m2 <> '' THEN substr(m2, 1, 4) || '-' || substr(m2, 6, 2) END,
                  CASE WHEN m3 <> '' THEN substr(m3, 1, 4) || '-' || substr(m3, 5, 2) END,
                  '2001-12') AS date,
         CASE WHEN NOT regexp_matches(href, '(?i)\.xlsx?$') THEN NULL
              WHEN regexp_matches(href, '(?i)cpi-u-\d{6}\.xlsx$') OR regexp_matches(text, '(?i)cpi-u-\d{6}\.xlsx$') THEN 1
              WHEN regexp_matches(trim(text), '(?i)^CPI-U$') THEN 2
              WHEN regexp_matches(text, '(?i)cpi.*u') OR regexp_matches(href, '(?i)cpi.*u') THEN 3 END AS priority
  FROM ld3),
wl AS (
  SELECT page_id, pos, url, filename, date, text AS description, text AS link_text, priority,
         coalesce(TRY_CAST(replace(date, '-', '') AS BIGINT), 0) AS ym
  FROM links_all WHERE priority IS NOT NULL)"""

SQL["url_resolve"] = f"WITH {LISTING} SELECT page_id, pos, url, filename FROM lf"
SQL["date_from_text"] = f"WITH {LISTING} SELECT page_id, pos, date FROM links_all"
SQL["month_from_text"] = f"""WITH {LISTING}
SELECT page_id, pos,
       CASE WHEN text = 'CPI-U' THEN NULL ELSE CAST(month(strptime(split_part(text, ' ', 1), '%B')) AS INTEGER) END
         AS month
FROM lk"""
SQL["link_priority"] = f"""WITH {LISTING}
SELECT page_id, pos, url, filename, date, description, link_text, priority FROM wl"""
SQL["link_rank"] = f"""WITH {LISTING}
SELECT page_id, pos, url, filename, date, description, link_text, priority,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority, ym DESC, pos) AS INTEGER) AS rank
FROM wl"""
SQL["link_target"] = f"""WITH {LISTING},
t AS (
  SELECT *, CASE WHEN lower(filename) LIKE '%cpi-u-199806.xlsx%' THEN 1
                 WHEN date LIKE '%1998-06%' OR filename LIKE '%199806%' THEN 2 ELSE 3 END AS tier
  FROM wl),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY tier, priority, ym DESC, pos) AS k FROM t)
SELECT page_id, pos, url, filename, date, priority, tier FROM b WHERE k = 1"""

# workbook round trips and sinks give back what went in
SQL["scan_first_sheet"] = SQL["sheet_records"]
SQL["scan_all_sheets"] = SQL["union_layouts"]
SQL["records_out"] = SQL["wide_record"]

# the newest publication: months that weren't published again stay 1 too low
PUBLISHED = PANEL + """,
published AS (
  SELECT category, date, "index" - CASE WHEN CAST(substr(date, 6, 2) AS INTEGER) % 3 = 0 THEN 1 ELSE 0 END AS "index",
         adjustment FROM panel)"""

SQL["stream_ingest"] = f"WITH {PUBLISHED} SELECT category, date, \"index\", adjustment FROM published"
SQL["stream_latest"] = f"""
WITH {PUBLISHED},
top AS (SELECT DISTINCT date FROM published ORDER BY date DESC LIMIT 2)
SELECT category, date, "index", adjustment FROM published WHERE date IN (SELECT date FROM top)
"""

SQL["panel_profile_merged"] = f"SELECT *, true AS estimate_is_near FROM ({SQL['panel_profile']})"

SQL["stream_quarantine"] = f"""
WITH {POINTS},
n AS (SELECT file, count(*) AS n_points FROM g8 GROUP BY file)
SELECT file, CASE WHEN k % 11 = 3 THEN 0 ELSE n_points END AS n_points,
       CASE WHEN k % 11 = 3 THEN 'not a workbook' END AS problem
FROM bk LEFT JOIN n USING (file) WHERE k % 11 = 3 OR n_points IS NOT NULL
"""

SQL["records_parquet"] = SQL["wide_record"]

SQL["merged_headers"] = f"""
WITH {SHEETS}
SELECT file, sheet, date AS current_month, nc AS c_nsa_previous, nc + 1 AS c_nsa_current,
       CASE WHEN v <> 4 THEN sc END AS c_sa_previous, CASE WHEN v <> 4 THEN sc + 1 END AS c_sa_current
FROM months WHERE v <> 3
"""

SQL["request_limits"] = """
WITH c AS (
  SELECT l_suppkey AS request_id, strftime(max(l_shipdate), '%Y-%m') AS date,
         least(count(DISTINCT concat_ws('/', p_brand, CAST(p_size AS VARCHAR), p_type)),
               [0, 1, 20, 21, 200, 201][l_suppkey % 6 + 1])::INTEGER AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey),
r AS (
  SELECT request_id, form, date, n AS n_categories,
         CASE WHEN n < 1 THEN 'at least one category must be specified'
              WHEN n > lim THEN 'maximum ' || lim || ' categories' END AS reason
  FROM c, (VALUES ('get', 20), ('post', 200)) f(form, lim))
SELECT request_id, form, date, n_categories, reason IS NULL AS valid, reason FROM r
"""

SERIES = """
wbs AS (
  SELECT o_orderpriority AS series, lower(substr(o_orderpriority, 3, 20)) || '-' || strftime(date_trunc('month', o_orderdate), '%Y%m')
           || '.xlsx' AS file,
         CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) + INTERVAL 8 HOUR AS mtime
  FROM orders GROUP BY ALL)"""

SQL["latest_file_by_series"] = f"""WITH {SERIES}
SELECT series, file, {TS.format(c='mtime')} AS mtime FROM wbs
QUALIFY row_number() OVER (PARTITION BY series ORDER BY mtime DESC, file DESC) = 1"""

SQL["asof_workbook"] = f"""
WITH {SERIES},
req AS (SELECT o_orderkey AS request_id, o_orderpriority AS series,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS asked_at FROM orders)
SELECT request_id, req.series, {TS.format(c='asked_at')} AS asked_at, file, {TS.format(c='mtime')} AS mtime
FROM req ASOF LEFT JOIN wbs ON req.series = wbs.series AND req.asked_at >= wbs.mtime
"""

SQL["manifest_changes"] = f"""
WITH m AS (SELECT date_trunc('month', o_orderdate) AS ms, count(*) AS n FROM orders GROUP BY 1),
span AS (SELECT min(year(ms)) AS a, max(year(ms)) + 1 AS b FROM m),
f AS (
  SELECT *, CAST(year(ms) AS INTEGER) AS y, 'cpi-u-' || strftime(ms, '%Y%m') || '.xlsx' AS file, month(ms) % 3 = 0 AS again,
         strftime(ms + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS t0,
         strftime(ms + INTERVAL 13 MONTH, '%Y-%m-%d %H:%M:%S') AS t1 FROM m)
SELECT y AS version, file, 'added' AS kind, NULL::BIGINT AS old_size, n AS size, NULL AS old_mtime, t0 AS mtime FROM f
UNION ALL
SELECT y + 1, file, 'changed', n, n + 1, t0, t1 FROM f WHERE again
UNION ALL
SELECT y + 2, file, 'removed', n + CAST(again AS INTEGER), NULL, CASE WHEN again THEN t1 ELSE t0 END, NULL
FROM f, span WHERE y + 2 <= b
"""

SQL["top_links"] = f"""WITH {LISTING}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY priority, date DESC, pos) AS INTEGER) AS rank,
       pos, filename, date, priority
FROM wl QUALIFY rank <= 5"""

SQL["link_rules"] = f"""WITH {LISTING},
r AS (
  SELECT page_id, pos, filename, date,
         CASE WHEN pos % 4 = 2 THEN 1 WHEN pos % 4 = 1 AND pos % 2 = 0 THEN 2 WHEN pos % 4 = 1 THEN 3
              ELSE 9 END AS priority
  FROM links_all)
SELECT * FROM r"""

SQL["limit_head"] = f"""
SELECT * FROM ({SQL["latest_points"]}) q
ORDER BY year DESC, month DESC, file, sheet, layout, r, c LIMIT 3
"""

SQL["header_norm"] = f"""
WITH {SHEETS},
lab AS (SELECT *, lower(strftime(ms - INTERVAL 1 MONTH, '%b. %Y')) AS pl, lower(strftime(ms, '%b. %Y')) AS cl
        FROM (SELECT *, CAST(date || '-01' AS DATE) AS ms FROM months WHERE v <> 3)),
cells AS (
  SELECT file, h AS r_raw, CAST(o + i AS INTEGER) AS c, t AS text
  FROM lab, (VALUES (0, 'indent level'), (1, 'expenditure category'), (2, 'relative importance'),
                    (7, 'unadjusted percent change')) x(i, t)
  UNION ALL SELECT file, h, nc + i, 'unadjusted indexes' FROM lab, (VALUES (0), (1)) x(i) WHERE i = 0 OR v <> 7
  UNION ALL SELECT file, h, sc + i, 'seasonally adjusted indexes' FROM lab, (VALUES (0), (1)) x(i)
  WHERE v <> 4 AND (i = 0 OR v <> 7)
  UNION ALL SELECT file, h + 1, nc + i, CASE i WHEN 0 THEN pl ELSE cl END FROM lab, (VALUES (0), (1)) x(i)
  UNION ALL SELECT file, h + 1, sc + i, CASE i WHEN 0 THEN pl ELSE cl END FROM lab, (VALUES (0), (1)) x(i) WHERE v <> 4
  UNION ALL SELECT file, h + 1, CAST(o + 7 AS INTEGER), pl || '- ' || cl FROM lab)
SELECT file, CAST(r_raw AS INTEGER) AS r_raw, CAST(c AS INTEGER) AS c, text, trim(text) AS text_stripped FROM cells
"""

SQL["series_label"] = """
SELECT DISTINCT 'supplier-' || l_suppkey || '.xlsx' AS file, 'supplier-' || l_suppkey AS ticker,
       'CPI_U_SUPPLIER-' || l_suppkey AS series_id
FROM lineitem
"""

SQL["stream_workbooks"] = SQL["union_layouts"]

SQL["period_label"] = f"""
WITH {POINTS}
SELECT file, sheet, layout, r, c,
       CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period
FROM g8
"""
