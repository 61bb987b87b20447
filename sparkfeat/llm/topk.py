"""Exact top-k search by inner product over KD-trees per shard.

Vectors are dealt to shards; each shard becomes one KD-tree row (median splits on
the widest dimension, tight bounding boxes). Queries travel in blocks. A block is
first searched in one home shard; the kth score found there is propagated and every
other shard starts from it. Inside a shard a box's bound on the inner product with
a query prunes whole subtrees, and each query visits its leaves best bound first
until the next bound is below its kth score. All scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, slices, table

SHARD = 2048         # vectors in a tree
BLOCK = 512          # queries in a block
LEAF = 64
EXACT = float(2 ** 53)


# ------------------------------------------------------------------ tree

def tree_shape(n: int):
    """Parent, first row, past row, is-leaf of the nodes (parents first): median splits depend on the count alone."""
    parent, first, past, leaf = [-1], [0], [n], []
    k = 0
    while k < len(first):
        a, b = first[k], past[k]
        leaf.append(b - a <= LEAF)
        if not leaf[k]:
            half = (b - a) // 2
            for lo, hi in ((a, a + half), (a + half, b)):
                parent.append(k)
                first.append(lo)
                past.append(hi)
        k += 1
    return np.array(parent), np.array(first), np.array(past), np.array(leaf)


def tree_order(vecs: np.ndarray) -> np.ndarray:
    """Rows in tree order: every inner node is cut at the median of its widest dimension."""
    parent, first, past, leaf = tree_shape(len(vecs))
    order = np.arange(len(vecs))
    for k in np.flatnonzero(~leaf) if vecs.shape[1] else ():
        a, b = first[k], past[k]
        own = vecs[order[a:b]]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        order[a:b] = order[a:b][np.argpartition(own[:, axis], (b - a) // 2, kind="introselect")]
    return order


def tree_of(vecs: np.ndarray):
    """Nodes and tight bounding boxes of rows that are in tree order; inner boxes come from their children."""
    parent, first, past, leaf = tree_shape(len(vecs))
    low = np.full((len(parent), vecs.shape[1]), np.inf)
    high = np.full((len(parent), vecs.shape[1]), -np.inf)
    for k in np.flatnonzero(leaf):
        low[k], high[k] = vecs[first[k]:past[k]].min(0), vecs[first[k]:past[k]].max(0)
    for k in range(len(parent) - 1, 0, -1):
        np.minimum(low[parent[k]], low[k], out=low[parent[k]])
        np.maximum(high[parent[k]], high[k], out=high[parent[k]])
    return parent, first, past, leaf, low, high


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: in doubles while every partial sum stays below 2**53, else in whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object)
    return whole(a).dot(whole(b).T)


def _at_most(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles, never above the exact value."""
    out = scores.astype(float)
    return np.nextafter(out, -np.inf) if scores.dtype == object else out


def search(tree, ids, vecs, query_ids, queries, k, bound):
    """(query row, vec_id, score) of all rows that may be among each query's best k.

    ``ids`` and ``vecs`` are in tree order. ``bound``: score that each query's kth best is known to reach (-inf: unknown).
    """
    parent, first, past, leaf, low, high = tree
    up = _product(np.maximum(queries, 0), high) + _product(np.minimum(queries, 0), low)
    alive = np.ones(up.shape, bool)
    for node in range(1, len(parent)):                     # a subtree goes with its root
        alive[:, node] = alive[:, parent[node]] & (up[:, node] >= bound)
    leaves = np.flatnonzero(leaf)
    reach = np.where(alive[:, leaves], up[:, leaves], -np.inf).astype(float)
    turn = np.argsort(-reach, axis=1, kind="stable")
    kth = np.array(bound, float)
    q_all, id_all, s_all = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, vecs.dtype if vecs.dtype == object else float)
    for r in range(len(leaves)):
        at = turn[:, r]
        # doubles above 2**53 may round a bound down: leave a margin there
        go = np.flatnonzero((reach[np.arange(len(at)), at] * (1 + 1e-12 * np.sign(reach[np.arange(len(at)), at])) >= kth)
                            & (reach[np.arange(len(at)), at] > -np.inf))
        if not len(go):
            break
        got = [(q_all, id_all, s_all)]
        for n in np.unique(at[go]):
            rows = go[at[go] == n]
            a, b = first[leaves[n]], past[leaves[n]]
            score = _product(queries[rows], vecs[a:b])
            hit = (score >= kth[rows][:, None]) & (ids[a:b][None, :] != query_ids[rows][:, None])
            i, j = np.nonzero(hit)
            got.append((rows[i], ids[a:b][j], score[i, j]))
        q_all, id_all, s_all = (np.concatenate(x) for x in zip(*got))
        by = np.lexsort((id_all, -s_all, q_all)) if s_all.dtype != object else np.array(
            sorted(range(len(q_all)), key=lambda x: (q_all[x], -s_all[x], id_all[x])), np.int64)
        q_all, id_all, s_all = q_all[by], id_all[by], s_all[by]
        start = np.searchsorted(q_all, q_all)
        rank = np.arange(len(q_all)) - start
        keep = rank < k
        q_all, id_all, s_all, rank = q_all[keep], id_all[keep], s_all[keep], rank[keep]
        last = rank == k - 1
        kth[q_all[last]] = np.maximum(kth[q_all[last]], _at_most(s_all[last]))
    return q_all, id_all, s_all


# ------------------------------------------------------------------ packing

def _pack_of(size, names, trees):
    """Rows sorted by ``names`` to packed pieces of at most ``size`` vectors each; ``trees``: in tree order."""
    def run(batches):
        key, ids, vecs, piece = None, [], [], 0

        def emit():
            x = np.floor(64 * np.array(vecs, float).reshape(len(ids), -1))
            order = tree_order(x) if trees else np.arange(len(ids))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int32()) for v in key), pa.array([piece], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([np.array(ids, "<i8")[order].tobytes()], pa.binary()),
                 pa.array([x[order].astype("<f8").tobytes()], pa.binary())],
                names=[*names, "piece", "n", "ids", "vecs"])

        for batch in slices(batches):
            cols = [batch.column(c).to_pylist() for c in (*names, "vec_id")]
            flat = batch.column("x")
            values, size_of = np.asarray(flat.flatten()), np.asarray(flat.value_lengths())
            edges = np.concatenate([[0], np.cumsum(size_of)])
            for r in range(len(flat)):
                here = tuple(c[r] for c in cols[:-1])
                if here != key or len(ids) >= size:
                    if ids:
                        yield emit()
                    piece = piece + 1 if here == key else 0
                    key, ids, vecs = here, [], []
                ids.append(cols[-1][r])
                vecs.append(values[edges[r]:edges[r + 1]])
        if ids:
            yield emit()
    return run


def _unpack(ids, vecs):
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(vecs, "<f8").reshape(len(ids), -1)


def _search_of(k, packed):
    """Search each joined (tree, block) row; with ``packed``, return the block with its bounds."""
    def run(batches):
        for batch in slices(batches):
            for row in batch.to_pylist():
                query_ids, queries = _unpack(row["q_ids"], row["q_vecs"])
                bound = np.full(len(query_ids), -np.inf) if row.get("bounds") is None else np.frombuffer(row["bounds"], "<f8")
                q, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                if row["ids"] is not None:
                    ids, vecs = _unpack(row["ids"], row["vecs"])
                    q, found, score = search(tree_of(vecs), ids, vecs, query_ids, queries, k, bound)
                if packed:
                    count = np.bincount(q, minlength=len(query_ids))
                    new = np.full(len(query_ids), -np.inf)
                    np.minimum.at(filled := np.full(len(query_ids), np.inf), q, _at_most(score))
                    new[count >= k] = filled[count >= k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row[c]], pa.int32()) for c in ("dim", "block", "q_piece", "home")]
                        + [pa.array([x], pa.binary()) for x in (row["q_ids"], row["q_vecs"], new.astype("<f8").tobytes())]
                        + [pa.array([query_ids[q].tolist()], pa.list_(pa.int64())), pa.array([found.tolist()], pa.list_(pa.int64())),
                           pa.array([[int(s) for s in score]], pa.list_(pa.int64()))],
                        names=["dim", "block", "q_piece", "home", "q_ids", "q_vecs", "bounds", "query_id", "vec_id", "score"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[q], pa.int64()), pa.array(found, pa.int64()),
                         pa.array([int(s) for s in score], pa.int64())], names=["query_id", "vec_id", "score"])
    return run


# ------------------------------------------------------------------ operator

def _packed(points: DataFrame, names: list[str], size: int, trees: bool = False) -> DataFrame:
    return (points.repartition(*names).sortWithinPartitions(*names, "vec_id")
            .mapInArrow(_pack_of(size, names, trees), ", ".join(f"{n} int" for n in (*names, "piece", "n")) + ", ids binary, vecs binary"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
          embedding: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products.

    Components are floor(64 x); ties go to the smaller vec_id; fewer candidates give
    fewer rows. A query's own id is no candidate. Vectors that are null, hold a null
    or non-finite component, or have a null id take no part; only vectors of equal
    length are compared. Repeated rows are candidates each; a repeated query id is
    searched once, with its shortest vector, of equally long ones the smallest by components. Scores must fit a long. No vectors or queries: no rows. Other
    columns are ignored.
    """
    x = F.col("x")
    points = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"),
                            is_query.alias("is_query"))
    points = points.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).withColumn("dim", F.size("x"))
    points = materialize(points, "points")
    n, n_query = points.count(), points.where("is_query").count()
    slots, blocks = max(1, -(-n // shard)), max(1, -(-n_query // block))
    slot = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slots)).cast("int")
    trees = materialize(_packed(points.withColumn("slot", slot), ["dim", "slot"], 2 * shard, True), "trees")
    asked = points.where("is_query").groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("v")).select("vec_id", "v.dim", "v.x").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int"))
    asked = materialize(_packed(asked, ["dim", "block"], 2 * block).select(
        "dim", "block", F.col("piece").alias("q_piece"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"),
        F.pmod("block", F.lit(slots)).cast("int").alias("home")), "asked")
    drop_materialized(points)

    # First each block in its home tree, then, with the kth scores found there, in all others.
    home = trees.where("piece = 0").select("dim", F.col("slot").alias("home"), "ids", "vecs")
    first = materialize(asked.join(home, ["dim", "home"], "left").mapInArrow(
        _search_of(k, True), "dim int, block int, q_piece int, home int, q_ids binary, q_vecs binary, bounds binary, "
        "query_id array<long>, vec_id array<long>, score array<long>"), "first")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = max(parts, slots * blocks // 8)               # few (tree, block) pairs in a task
    keys = ["dim", "block", "slot"]
    sent = (first.select("dim", "block", "q_piece", "home", "q_ids", "q_vecs", "bounds",
                         F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).repartition(spread, *keys))
    held = (trees.select("dim", "slot", "piece", "ids", "vecs",
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).repartition(spread, *keys))
    rest = (sent.join(held, keys).where("slot <> home or piece > 0")
            .select("q_ids", "q_vecs", "bounds", "ids", "vecs")
            .mapInArrow(_search_of(k, False), "query_id long, vec_id long, score long"))
    found = first.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("r")).select("r.*").unionAll(rest)
    # Each shard passed on k rows of a query at most, and only scores that reach its home kth.
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_kdtree_topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
