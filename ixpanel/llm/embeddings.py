"""Near-duplicate vectors by cosine, over inverted lists with product-quantised residuals.

A coarse quantiser (k-means on a bounded sample) deals the vectors to lists; within a
list, a vector is its list's centre plus a code of each residual subspace. A query
probes every list that can hold a vector within the radius: a neighbour's cell is no
further than the radius beyond the bisector of the two centres. Candidates come from
asymmetric distances, looked up in a table per query and list; as each indexed vector
keeps the length of its code's error, the triangle inequality turns the lookup into a
bound, and no neighbour is lost. The cosine of the candidates is then computed exactly
in double precision.

Equal vectors form one class before the search and aren't paired. Lists and their
queries are dealt out in tiles of TILE rows, so a crowded list is spread over tasks;
a tile pair returns each vector's weight of links and a star forest of the links, not
the links themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite values
link with nothing (n_links 0, their own component); vectors of different lengths don't
link; repeated rows are vectors of their own, with the same vec_id; of a component's
numbers the smallest that isn't null names it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, prepare, table
from ixpanel.llm.components import connected_components, star_forest

COSINE = 0.95
SAMPLE = 30_000            # vectors that the quantisers are fitted on, at most
MAX_LISTS = 4096
SUBSPACES = 8
CODES = 64
TILE = 2048                # rows of a list, and of its queries, in one task group, on average at most
SLACK = 1e-4               # for single precision in distances
VALID = ("embedding is not null and size(embedding) > 0 and "
         "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and "
         "exists(embedding, x -> x != 0)")


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squared(x[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.nonzero(size)[0]
        sums = np.add.reduceat(x[order], (np.cumsum(size) - size)[full], axis=0)
        centres[full] = sums / size[full, None]
        empty = np.nonzero(size == 0)[0]
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


class Index:
    """Coarse centres and subspace codebooks."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float):
        rng = np.random.default_rng(0)
        x = sample.astype(np.float32)
        k = int(max(1, min(MAX_LISTS, np.sqrt(n) / 2, len(x) // 8)))
        self.centres = _kmeans(x, k, 8, rng)
        self.apart = np.sqrt(_squared(self.centres, self.centres))
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
        near = np.concatenate([_squared(x[i:i + 4096], self.centres).argmin(axis=1) for i in range(0, len(x), 4096)])
        rest = x - self.centres[near]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [_kmeans(rest[:, s], min(CODES, len(x)), 6, rng) for s in self.cuts]

    def lists(self, x: np.ndarray):
        """List of each vector, and a matrix of the lists (not before its own) that it probes."""
        d = _squared(x, self.centres)
        own = d.argmin(axis=1)
        beyond = d - d[np.arange(len(x)), own][:, None]
        probe = beyond <= 2 * (self.radius + SLACK) * self.apart[own] + SLACK
        return own, probe & (np.arange(len(self.centres)) >= own[:, None])

    def encode(self, x: np.ndarray, own: np.ndarray):
        """Codes of the residuals, and the lengths of the codes' errors."""
        rest = x - self.centres[own]
        codes = np.stack([_squared(rest[:, s], b).argmin(axis=1) for s, b in zip(self.cuts, self.books)], axis=1)
        wrong = rest - np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(wrong, axis=1)

    def candidates(self, q: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray):
        """Index pairs (query, member) of list ``at`` that may be within the radius."""
        i, j = [], []
        for begin in range(0, len(q), 256):
            rest = q[begin:begin + 256] - self.centres[at]
            found = np.zeros((len(rest), len(codes)), np.float32)
            for m, (s, book) in enumerate(zip(self.cuts, self.books)):
                found += _squared(rest[:, s], book)[:, codes[:, m]]
            a, b = np.nonzero(found <= (self.radius + error + SLACK) ** 2)
            i.append(a + begin)
            j.append(b)
        return np.concatenate(i), np.concatenate(j)


def _assign(bc):
    def run(batches):
        index = bc.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("embedding").to_pylist()).astype(np.float32)
            own, probe = index.lists(x)
            codes, error = index.encode(x, own)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("n"), b.column("embedding"), pa.array(own.astype(np.int32)),
                 pa.array([np.nonzero(p)[0].astype(np.int32) for p in probe], pa.list_(pa.int32())),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float64))],
                ["node", "n", "embedding", "list", "probes", "codes", "error"])
    return run


def _search(bc, cosine: float):
    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        index, at = bc.value, int(key[0])
        none = pd.DataFrame({"node": [], "links": [], "centre": []}).astype("int64")
        if not len(queries) or not len(members):
            return none
        q, x = _unit(queries["embedding"]), _unit(members["m_embedding"])
        codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
        i, j = index.candidates(q.astype(np.float32), at, codes, members["error"].to_numpy())
        node_q, node_x = queries["node"].to_numpy(), members["m_node"].to_numpy()
        once = (queries["list"].to_numpy()[i] != at) | (node_q[i] < node_x[j])
        i, j = i[once], j[once]
        hit = np.concatenate([np.einsum("ij,ij->i", q[i[s:s + 65536]], x[j[s:s + 65536]]) >= cosine
                              for s in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[hit], j[hit]
        if not len(i):
            return none
        nodes, at_node = np.unique(np.concatenate([node_q[i], node_x[j]]), return_inverse=True)
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, at_node, np.concatenate([members["m_n"].to_numpy()[j], queries["n"].to_numpy()[i]]))
        centre = np.arange(len(nodes))
        leaf, root = star_forest(len(nodes), at_node[:len(i)], at_node[len(i):])
        centre[leaf] = root
        return pd.DataFrame({"node": nodes, "links": links, "centre": nodes[centre]})
    return run


def _linked(classes: DataFrame, cosine: float) -> DataFrame:
    """``classes`` (node, embedding, n) of one length: (node, links, centre) of tile pairs."""
    spark = classes.sparkSession
    n = classes.count()
    pick = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = [r["embedding"] for r in classes.where(pick).select("embedding").limit(SAMPLE).collect()]
    if not sample:                       # a tiny table may miss the rate
        sample = [r["embedding"] for r in classes.select("embedding").limit(SAMPLE).collect()]
    bc = spark.sparkContext.broadcast(Index(_unit(sample), n, cosine))   # at most MAX_LISTS centres
    rows = cut(classes.select("node", "n", "embedding").mapInArrow(
        _assign(bc), f"node long, n long, embedding {classes.schema['embedding'].dataType.simpleString()}, "
        "list int, probes array<int>, codes binary, error double"))
    asked = rows.select(F.explode("probes").alias("at")).groupBy("at").agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("q_tiles"))
    held = rows.groupBy(F.col("list").alias("at")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("x_tiles"))
    tiles = cut(held.join(asked, "at"))             # at most MAX_LISTS rows
    tile = lambda of, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    queries = (rows.select("node", "n", "embedding", "list", F.explode("probes").alias("at"))
               .join(F.broadcast(tiles), "at").withColumn("q", tile("q_tiles", 1)).withColumn("x", every("x_tiles"))
               .select("at", "q", "x", "node", "n", "embedding", "list"))
    members = (rows.withColumn("at", F.col("list")).join(F.broadcast(tiles), "at")
               .withColumn("x", tile("x_tiles", 2)).withColumn("q", every("q_tiles"))
               .select("at", "q", "x", F.col("node").alias("m_node"), F.col("n").alias("m_n"),
                       F.col("embedding").alias("m_embedding"), "codes", "error"))
    return queries.groupBy("at", "q", "x").cogroup(members.groupBy("at", "q", "x")).applyInPandas(
        _search(bc, cosine), "node long, links long, centre long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", F.when(F.expr(VALID), F.col("embedding")).alias("embedding"))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = cut(cut(classes).withColumn("node", F.monotonically_increasing_id()))
    pairs = None
    for r in classes.select(F.size("embedding").alias("d")).distinct().collect():    # lengths, nearly always one
        found = _linked(classes.where(F.size("embedding") == r["d"]), cosine)
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    pairs = cut(pairs)
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")))
    named = cut(classes.join(links, "node", "left").join(roots, classes.node == roots.id, "left").select(
        "embedding", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("root")))
    first = cut(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(named.join(first, "root").select("embedding", "n_links", "component_id"))
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(named.withColumnRenamed("embedding", "of"), F.col("embedding") == F.col("of"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT t.vec_id, coalesce(deg.n, 0) AS n_links, coalesce(component_id, t.vec_id) AS component_id,
  coalesce(component_id, t.vec_id) = t.vec_id AS kept
FROM embeddings t LEFT JOIN comp ON comp.id = t.vec_id LEFT JOIN deg ON deg.a = t.vec_id
"""
