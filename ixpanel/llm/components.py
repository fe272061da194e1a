"""Connected components of a link table by alternating large-star and small-star rounds.

Every round is a few grouped minima and joins, so no component, however
large, meets in one task: minima are pre-aggregated before the shuffle, and
the joins read written tables on both sides, which lets AQE split a node that
holds a large share of all links. The number of rounds is logarithmic.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ixpanel.llm.common import cut


def star_forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among 0..n-1 as a star forest: (node, least node of its component), centres left out."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    leaf = np.nonzero(label != np.arange(n))[0]
    return leaf, label[leaf]


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b): two node numbers. Returns (id, root) for every node that is not
    the least of its component; nodes without a link, and the least ones, have no row.
    Repeated links, loops and nulls are ignored; an empty table gives an empty one."""
    e = cut(links.where("a != b")
            .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = _signature(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")))
        large = cut(e.join(least, e.lo == least.u).select("hi", F.col("m").alias("lo")).distinct())
        first = cut(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "u"))
        small = large.join(first, large.hi == first.u).select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        e = cut(small.select("x.hi", "x.lo").where("hi != lo").distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
