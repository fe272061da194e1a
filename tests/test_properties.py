"""Properties of the batch answers on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

from ixpanel.operators import panel as P
from ixpanel.operators import requests as RQ
from ixpanel.plans import views as V

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def batch(spark):
    cells = V.sheet_cells(spark, SF_SMALL).cache()
    checked, looked_up, wide, long = RQ.answer(cells, V.requests(spark, SF_SMALL))
    return cells, checked, looked_up.cache(), wide.cache(), long.cache()


def test_wide_long_wide_identity(batch):
    _, _, _, wide, long = batch
    w = wide.withColumnRenamed("previous_month", "p").withColumnRenamed("current_month", "c")
    back = long.select("request_id", "ord").distinct().join(w.select("request_id", "ord", "p", "c"),
                                                            ["request_id", "ord"])
    rebuilt = (long.join(back, ["request_id", "ord"])
               .groupBy("request_id", "ord", "category").agg(*[
                   F.max(F.when((F.col("adjustment") == adj) & (F.col("date") == F.col(m)), F.col("index")))
                   .alias(f"{adj}_{k}")
                   for adj in ("nsa", "sa") for k, m in (("previous", "p"), ("current", "c"))]))
    cols = ["request_id", "ord", "category", "nsa_previous", "nsa_current", "sa_previous", "sa_current"]
    # wide rows with at least one value come back exactly; all-null rows have no long rows
    has = F.lit(False)
    for c in cols[3:]:
        has = has | F.col(c).isNotNull()
    a = sorted(map(tuple, wide.filter(has).select(cols).collect()))
    b = sorted(map(tuple, rebuilt.select(cols).collect()))
    assert a == b and len(a) > 0


def test_found_plus_missing_is_requested(batch):
    _, checked, looked_up, wide, _ = batch
    cov = RQ.coverage(looked_up)
    missing = RQ.missing_categories(looked_up).groupBy("request_id").count()
    j = cov.join(missing, "request_id", "left").fillna(0, ["count"])
    assert j.filter(F.col("found_wide") + F.col("count") != F.col("requested")).count() == 0
    valid = checked.filter(F.col("reason").isNull()).select("request_id", "n_categories")
    assert cov.join(valid, "request_id").filter(F.col("requested") != F.col("n_categories")).count() == 0
    assert cov.count() == valid.count()


def test_permuted_request_permutes_answer(spark, batch):
    cells = batch[0]
    some = cells.filter((F.col("c") == 1) & (F.col("r_raw") >= 6) & (F.col("file") == "cpi-u-199506.xlsx"))
    known = [r.raw for r in some.orderBy("raw").limit(3).collect()]
    names = [known[2], "Brand#99", known[0], known[2], known[1]]
    perm = [4, 2, 0, 3, 1]
    date = cells.filter(F.col("file") == "cpi-u-199506.xlsx").select(F.regexp_extract("file", r"cpi-u-(\d{4})(\d{2})", 1).alias("y"),
                        F.regexp_extract("file", r"cpi-u-(\d{4})(\d{2})", 2).alias("m")).first()
    d = f"{date.y}-{date.m}"
    req = spark.createDataFrame([(1, names, d), (2, [names[i] for i in perm], d)],
                                "request_id long, categories array<string>, date string")
    _, _, wide, _ = RQ.answer(cells, req, "post")
    rows = {(r.request_id, r.ord): (r.category, r.nsa_previous, r.nsa_current, r.sa_previous, r.sa_current)
            for r in wide.collect()}
    for new_pos, old_pos in enumerate(perm):
        assert rows.get((2, new_pos)) == rows.get((1, old_pos))
    assert (1, 1) not in rows            # the unknown name finds nothing


def test_recent_periods_idempotent(spark):
    p = V.panel(spark, SF_SMALL).withColumn("year", F.substring("date", 1, 4).cast("int")) \
         .withColumn("month", F.substring("date", 6, 2).cast("int"))
    once = P.recent_periods(p, 2)
    assert sorted(map(tuple, P.recent_periods(once, 2).collect())) == sorted(map(tuple, once.collect()))
