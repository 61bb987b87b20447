"""Centroid clustering with geometric drift tightening.

Every vector keeps its cluster, an upper bound of the distance to its own centroid and a
lower bound of the distance to every other one. After the centroids have moved, a lower
bound must shrink by as much as any other centroid can have come nearer. Full drift would
take the longest move; here the vectors of a cluster are known to lie in a sphere around
their old centroid, and in the plane through the sphere's centre and a centroid's old and
new place the gain is at most the length of the move times the cosine of the smallest angle
between the move and a ray from its middle into the sphere. Vectors whose bounds still tell
their cluster are left alone, the others are scanned exactly in whole numbers.

Vectors are packed once into blocks of a table bucketed by block; bounds are a small table
bucketed alike, so the rounds join the two without shuffling vectors. Sums of centroids are
whole numbers kept up by the vectors that changed their cluster.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import materialize, slices, table
from sparkfeat.session import checkpoint_dir

BLOCK = 1024              # vectors in a block
LARGEST = 2 ** 27         # whole components below this keep squared distances of 64 of them in a long
SLACK = 1e-9              # bounds are taken wider by this share, so rounding never decides


# ------------------------------------------------------------------ plane geometry

def gain(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """Upper bound of how much nearer a centroid that moved from ``old`` to ``new`` came to
    any point of the sphere; never above the length of the move.

    With m the middle of the move, |x-old| - |x-new| = 2 (x-m).(new-old) / (|x-old| + |x-new|),
    and the divisor is at least 2 |x-m|: the gain is at most the move's length times the
    cosine of the angle at m. Seen from m the sphere spans asin(radius / distance).
    """
    move = new - old
    length = float(np.sqrt(move @ move))
    if length == 0.0:
        return 0.0
    ray = centre - (old + new) / 2
    far = float(np.sqrt(ray @ ray))
    if far <= radius * (1 + SLACK):
        return length
    angle = np.arccos(np.clip(ray @ move / (far * length), -1, 1)) - np.arcsin(min(1.0, radius / far)) - 1e-7
    return length * float(np.cos(min(max(angle, 0.0), np.pi / 2)))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bounds of each cluster's vectors shrink."""
    k = len(old)
    out = np.zeros(k)
    for i in range(k):
        if radius[i] >= 0:                                # -1: no vectors
            out[i] = max((gain(old[i], radius[i], old[j], new[j]) for j in range(k) if j != i), default=0.0)
    return out * (1 + SLACK)


def half_gaps(centres: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to its nearest other one."""
    gap = np.full(len(centres), np.inf)
    for i in range(len(centres)):
        d = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        d[i] = np.inf
        gap[i] = d.min()
    return gap / 2 * (1 - SLACK)


# ------------------------------------------------------------------ exact distances

def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    if not x.size or not len(centres):
        return np.zeros((len(x), len(centres)), np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(centres).max())) + 1
    if 4 * top * top * x.shape[1] < 2 ** 53:              # every sum is a whole number that a double holds
        a, b = x.astype(float), centres.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centres], axis=1)


def assign(x, cluster, upper, lower, centres, drift, loose, half):
    """New (cluster, upper, lower, rows scanned) after the centroids moved; cluster None: all are scanned."""
    n, k = len(x), len(centres)
    if cluster is None:
        cluster, upper, lower = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        unsure = np.arange(n)
    else:
        upper, lower = upper + drift[cluster], lower - loose[cluster]
        cluster = cluster.copy()
        sure_from = np.maximum(lower, half[cluster])
        unsure = np.flatnonzero(~(upper < sure_from))
        if len(unsure):                                   # the exact distance to the own centroid may do
            own = np.empty(len(unsure), np.int64)
            for c in np.unique(cluster[unsure]):
                at = cluster[unsure] == c
                own[at] = squares(x[unsure[at]], centres[c:c + 1])[:, 0]
            upper[unsure] = np.sqrt(own.astype(float)) * (1 + SLACK)
            unsure = unsure[~(upper[unsure] < sure_from[unsure])]
    if len(unsure):
        d = squares(x[unsure], centres)
        best = d.argmin(1)                                # ties: the smaller number
        row = np.arange(len(unsure))
        cluster[unsure] = best
        upper[unsure] = np.sqrt(d[row, best].astype(float)) * (1 + SLACK)
        if k > 1:
            d[row, best] = np.iinfo(np.int64).max
            lower[unsure] = np.sqrt(d.min(1).astype(float)) * (1 - SLACK)
        else:
            lower[unsure] = np.inf
    return cluster, upper, lower, len(unsure)


# ------------------------------------------------------------------ blocks

def _pack(dims: int):
    """Vectors of a partition to blocks; whole components in two or four bytes each."""
    def run(batches):
        ids, vecs, piece, part = [], [], 0, 0

        def emit():
            x = np.array(vecs).reshape(len(ids), dims)
            small = np.abs(x).max(initial=0) < 2 ** 15
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + piece], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([2 if small else 4], pa.int32()), pa.array([x.astype("<i2" if small else "<i4").tobytes()], pa.binary())],
                names=["block", "ids", "width", "vecs"])

        for batch in slices(batches):
            flat = batch.column("x")
            x = np.floor(1024 * np.asarray(flat.flatten())).reshape(len(flat), dims)
            for i, v, p in zip(batch.column("vec_id").to_pylist(), x, batch.column("part").to_pylist()):
                part = p
                ids.append(i)
                vecs.append(v)
                if len(ids) >= BLOCK:
                    yield emit()
                    ids, vecs, piece = [], [], piece + 1
        if ids:
            yield emit()
    return run


def _vectors(row, dims):
    return np.frombuffer(row["vecs"], "<i2" if row["width"] == 2 else "<i4").reshape(-1, dims).astype(np.int64)


def _held(row):
    """Cluster, upper and lower bounds of a block; None before the first round."""
    if row.get("cluster") is None:
        return None, None, None
    return (np.frombuffer(row["cluster"], "<i4"), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8"))


STATE = ("block long, cluster binary, upper binary, lower binary, reach array<double>, scanned long, "
         "change array<long>, grown array<long>")


def _round(centres, drift, loose, half):
    """Blocks with their bounds to new bounds; ``change`` and ``grown``: changes of the clusters'
    component sums and sizes (null: none)."""
    k, dims = centres.shape

    def run(batches):
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                x = _vectors(row, dims)
                before, upper, lower = _held(row)
                cluster, upper, lower, scanned = assign(x, before, upper, lower, centres, drift, loose, half)
                reach = np.full(k, -1.0)
                np.maximum.at(reach, cluster, upper)
                moved = np.arange(len(x)) if before is None else np.flatnonzero(cluster != before)
                sums, size = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
                np.add.at(sums, cluster[moved], x[moved])
                np.add.at(size, cluster[moved], 1)
                if before is not None:
                    np.subtract.at(sums, before[moved], x[moved])
                    np.subtract.at(size, before[moved], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]], pa.int64()), pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
                     pa.array([upper.astype("<f8").tobytes()], pa.binary()), pa.array([lower.astype("<f8").tobytes()], pa.binary()),
                     pa.array([reach.tolist()], pa.list_(pa.float64())), pa.array([scanned], pa.int64()),
                     pa.array([sums.ravel().tolist() if len(moved) else None], pa.list_(pa.int64())),
                     pa.array([size.tolist() if len(moved) else None], pa.list_(pa.int64()))],
                    names=[c.split()[0] for c in STATE.split(", ")])
    return run


def _rows(centres):
    """Blocks with their clusters to (vec_id, cluster, distance) rows."""
    def run(batches):
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                x, cluster = _vectors(row, centres.shape[1]), np.frombuffer(row["cluster"], "<i4")
                distance = ((x - centres[cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                    names=["vec_id", "cluster", "distance"])
    return run


class _Bucketed:
    """A table in the shared folder, bucketed by block."""

    def __init__(self, df: DataFrame, parts: int, name: str):
        self.spark = df.sparkSession
        self.name = f"llm_{name}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        fs = self._fs()
        fs[0].deleteOnExit(fs[1])
        df.write.option("path", self.path).bucketBy(parts, "block").sortBy("block").saveAsTable(self.name)

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(conf), at

    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        fs, at = self._fs()
        fs.delete(at, True)


def _sums(state: DataFrame, column: str, how) -> dict[int, int | float]:
    """Position -> aggregate of an array column (as many rows as positions reach the driver)."""
    return dict(tuple(r) for r in state.select(F.posexplode(column)).groupBy("pos").agg(how(F.col("col"))).collect())


def _whole(column):
    return F.sum(column.cast("decimal(20,0)"))


# ------------------------------------------------------------------ operator

def sphere_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3,
                    vec_id: str = "vec_id", embedding: str = "embedding", log: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; components are
    floor(1024 x) and must be below 2**27 in magnitude (a larger one's squared distances do
    not fit a long: such vectors take no part). Centroids start as the ``k`` kept vectors with
    the smallest sha256 of "seed:vec_id" (vectors without an id last, ties by components; as
    many as there are, if fewer). Each round assigns all vectors to the nearest centroid (ties:
    smaller number) and replaces non-empty centroids by floor(sum / count); vectors are then
    assigned once more. Rounds that cannot change anything any more are not run. Repeated rows
    and ids count each. No kept vectors: no rows. Other columns are ignored. ``log`` gets the
    number of vectors scanned against all centroids in each round.
    """
    spark, x = vectors.sparkSession, F.col("x")
    points = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    points = points.where((F.size("x") == dims) & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v) | (F.abs(F.floor(1024 * v).cast("double")) >= LARGEST) | (F.abs(v) >= LARGEST)))
    start = (points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
             .orderBy(F.asc_nulls_last("h"), "x").limit(k).collect())
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = np.floor(1024 * np.array([r.x for r in start], float)).astype(np.int64)
    k = len(centres)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _Bucketed(points.withColumn("part", F.spark_partition_id().cast("long"))
                       .mapInArrow(_pack(dims), "block long, ids array<long>, width int, vecs binary")
                       .repartition(parts, "block"), parts, "vectors")

    total, size = [0] * (k * dims), [0] * k
    state, drift, loose, half = None, np.zeros(k), np.zeros(k), np.zeros(k)
    for turn in range(rounds + 1):
        bounds = ["cluster", "upper", "lower"]
        joined = blocks.df().select("block", "width", "vecs")
        if state is not None:
            joined = joined.join(state.df().select("block", *bounds), "block")
        new = _Bucketed(joined.mapInArrow(_round(centres, drift, loose, half), STATE), parts, "bounds")
        if state is not None:
            state.drop()
        state = new
        if log is not None:
            log.append(state.df().agg(F.sum("scanned")).first()[0])
        moved = _sums(state.df(), "change", _whole)
        for at, v in moved.items():
            total[at] += int(v)
        for at, v in _sums(state.df(), "grown", _whole).items():
            size[at] += int(v)
        if turn == rounds:
            break
        old, centres = centres, np.array([[total[c * dims + d] // size[c] for d in range(dims)] if size[c] else centres[c]
                                          for c in range(k)], np.int64)
        if (old == centres).all():
            break
        reach = _sums(state.df(), "reach", F.max)
        radius = np.array([reach[c] for c in range(k)])
        a, b = old.astype(float), centres.astype(float)
        drift = np.sqrt(((a - b) ** 2).sum(1)) * (1 + SLACK)
        loose, half = loosening(a, b, radius), half_gaps(b)

    found = materialize(blocks.df().join(state.df().select("block", "cluster"), "block")
                        .mapInArrow(_rows(centres), "vec_id long, cluster int, distance long"), "clusters")
    blocks.drop()
    state.drop()
    inertia = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(_whole(F.col("distance"))).collect()}
    most = 2 ** 63 - 1                                    # sums beyond a long stay at its largest value
    per = F.array(*[F.lit(min(inertia.get(c, 0), most)).cast("long") for c in range(k)])
    marks = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centres.tolist()])
    return found.select("vec_id", "cluster", "distance", F.get(per, "cluster").alias("cluster_inertia"),
                        F.lit(min(sum(inertia.values()), most)).cast("long").alias("inertia"),
                        F.get(marks, "cluster").alias("centroid_sha256"))


def op12_sphere_clusters(spark, sf_dir):
    return sphere_clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Plain rounds: every vector against every centroid."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, e AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k})
)"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e, min(list_sum([(e[i] - c[i]) * (e[i] - c[i]) FOR i IN range(1, {dims + 1})])::HUGEINT * {k} + j) AS m
  FROM v, c{t} GROUP BY r
)""")
        if t < rounds:
            steps.append(f"""s{t} AS (
  SELECT j, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT m % {k} AS j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{t}) GROUP BY j, i
), c{t + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(any_value(n.c), any_value(c.c)) AS c FROM c{t} c
  LEFT JOIN (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{t} GROUP BY j) n ON n.j = c.j GROUP BY c.j
)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, c.j::INTEGER AS cluster, (m // {k})::BIGINT AS distance, (sum(m // {k}) OVER (PARTITION BY c.j))::BIGINT AS cluster_inertia,
       (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.m % {k}"""


OP12_SQL = _sql()
