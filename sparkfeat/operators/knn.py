"""k-nearest-neighbour imputation (IMP-5) and the orchestrated fill (IMP-12).

Distances are ``nan_euclidean``: squared differences over the coordinates
present in both rows, scaled by (#columns / #shared columns), square root.
Neighbours are taken from *distinct* donor vectors with their row counts,
ordered by (distance, vector), so duplicates count as separate donors and
ties are broken the same way every time. The mean of the k donor values is
the fill; without any usable donor the training column mean is used.

Scale: work is done once per *distinct* recipient pattern, never per row.
Donors and recipients are dealt into blocks by hash; every pair of blocks is
one small matrix computation in a task, which passes on k donors per
recipient at most, and a window per recipient merges them. Any number of
distinct donor vectors works; nothing goes through the driver but the block
counts and the column means.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfeat.functions.lookup import load_fitted, save_fitted
from sparkfeat.session import cut_lineage

DONOR_BLOCK = 4096      # distinct donor vectors in a block
RECIPIENT_BLOCK = 512   # distinct recipient patterns in a block
MAX_ROW_DONORS = 200_000     # donors that a row-by-row fill sends to every task
ROW_CELLS = 1 << 21     # distances held at once by a row-by-row fill


def _value(c: str) -> Column:
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def nearest(x: np.ndarray, v: np.ndarray, k: int):
    """(recipient, donor, distance) of each recipient's k first donors by (distance, vector)."""
    ss, shared = np.zeros((len(x), len(v))), np.zeros((len(x), len(v)))
    for j in range(x.shape[1]):
        diff = v[None, :, j] - x[:, None, j]
        both = ~np.isnan(diff)
        ss += np.where(both, diff * diff, 0.0)
        shared += both
    dist = np.where(shared > 0, np.sqrt(ss * (x.shape[1] / np.maximum(shared, 1))), np.inf)
    kth = min(k, len(v)) - 1
    limit = np.partition(dist, kth, axis=1)[:, kth]
    order = np.lexsort([np.where(np.isnan(c), np.inf, c) for c in v.T[::-1]])
    place = np.empty(len(v), np.int64)
    place[order] = np.arange(len(v))
    i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
    by = np.lexsort((place[j], dist[i, j], i))
    i, j = i[by], j[by]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j = i[first], j[first]
    return i, j, dist[i, j]


def _nearest_of(width: int, k: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ask, give = batch.column("ask")[r].values, batch.column("give")[r].values
                numbers = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                v, n = numbers(give.field("v")), give.field("n").to_numpy(zero_copy_only=False)
                i, j, dist = nearest(numbers(ask), v, k)
                target = batch.column("target")[r].as_py()
                key = np.where(np.isnan(v), np.inf, v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), target), pa.int32()), ask.take(pa.array(i)),
                     pa.array(dist), pa.array(list(key[j]), pa.list_(pa.float64())),
                     pa.array(v[j, target]), pa.array(n[j], pa.int64())],
                    names=["target", "x", "dist", "key", "value", "n"])
    return run


class KnnImputer:
    def __init__(self, cols, k: int = 5, donor_block: int = DONOR_BLOCK, recipient_block: int = RECIPIENT_BLOCK):
        self.cols = list(cols)
        self.k = k
        self.donor_block, self.recipient_block = donor_block, recipient_block
        self.donors: DataFrame | None = None
        self.means: dict[str, float] = {}

    def _targets(self, x: Column, missing: bool) -> Column:
        """Positions of the columns that are (not) missing in the array ``x``."""
        every = F.array(*[F.lit(j) for j in range(len(self.cols))])
        return F.filter(every, lambda j: F.get(x, j).isNull() == F.lit(missing))

    def fit(self, train: DataFrame) -> "KnnImputer":
        """Column means and, per target column, the distinct donor vectors with counts (one aggregate)."""
        self.means = train.agg(*[F.avg(_value(c)).alias(c) for c in self.cols]).first().asDict()
        vec = train.select(F.array(*[_value(c) for c in self.cols]).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        self.donors = cut_lineage(vec.select("v", "n", F.explode(self._targets(F.col("v"), False)).alias("target")))
        return self

    def _imputed(self, patterns: DataFrame) -> DataFrame:
        """(x, __imp_0, ...) for the distinct patterns ``x``; null where a column has no usable donor."""
        wanted = cut_lineage(patterns.select("x", F.explode(self._targets(F.col("x"), True)).alias("target")))

        def blocks(rows: DataFrame, size: int) -> Column:
            count = {r["target"]: -(-r["count"] // size) for r in rows.groupBy("target").count().collect()}  # ≤ #columns rows
            pairs = [F.lit(v) for j in range(len(self.cols)) for v in (j, count.get(j, 0))]
            return F.create_map(*pairs)[F.col("target")]

        n_give, n_ask = blocks(self.donors, self.donor_block), blocks(wanted, self.recipient_block)
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        give = (self.donors.where(n_ask > 0).withColumn("db", F.pmod(F.xxhash64("v"), n_give).cast("int"))
                .groupBy("target", "db").agg(F.collect_list(F.struct("v", "n")).alias("give"))
                .select("target", "db", "give", spread(n_ask).alias("rb")))
        ask = (wanted.where(n_give > 0).withColumn("rb", F.pmod(F.xxhash64("x"), n_ask).cast("int"))
               .groupBy("target", "rb").agg(F.collect_list("x").alias("ask"))
               .select("target", "rb", "ask", spread(n_give).alias("db")))
        near = ask.join(give, ["target", "db", "rb"]).select("target", "ask", "give").mapInArrow(
            _nearest_of(len(self.cols), self.k),
            "target int, x array<double>, dist double, key array<double>, value double, n long")
        before = (Window.partitionBy("target", "x").orderBy("dist", "key")
                  .rowsBetween(Window.unboundedPreceding, -1))
        take = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(self.k) - F.coalesce(F.sum("n").over(before), F.lit(0))))
        filled = (near.withColumn("take", take).groupBy("target", "x")
                  .agg((F.sum(F.col("take") * F.col("value")) / F.sum("take")).alias("imp")))
        return filled.groupBy("x").agg(*[F.max(F.when(F.col("target") == j, F.col("imp"))).alias(f"__imp_{j}")
                                         for j in range(len(self.cols))])

    def save(self, path: str) -> None:
        save_fitted(path, self.donors.sparkSession, cols=self.cols, k=self.k, means=self.means, donors=self.donors)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "KnnImputer":
        kept = load_fitted(path, spark)
        knn = cls(kept["cols"], kept["k"])
        knn.means, knn.donors = kept["means"], kept["donors"].df
        return knn

    def for_rows(self, max_donors: int = MAX_ROW_DONORS):
        """The same fill as a function of a DataFrame without any action, row by row, for streams.

        The donors are read once and sent to every task, so there may be at most ``max_donors``
        (distinct donor vectors × columns); with more, ``transform`` is the way.
        """
        rows = self.donors.limit(max_donors + 1).collect()
        if len(rows) > max_donors:
            raise ValueError(f"over {max_donors} donors: too many to send to every task")
        width, k = len(self.cols), self.k
        give = {}
        for t in range(width):
            own = [r for r in rows if r.target == t]
            give[t] = (np.array([r.v for r in own], float).reshape(-1, width), np.array([r.n for r in own], np.int64))
        sent = self.donors.sparkSession.sparkContext.broadcast(give)

        @F.arrow_udf("array<double>")
        def fills(gaps: pa.Array) -> pa.Array:
            x = pc.list_flatten(gaps).to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            asked, back = np.unique(x, axis=0, return_inverse=True)       # NaN equals NaN here
            out = np.full(asked.shape, np.nan)
            for t, (v, n) in sent.value.items():
                ask = np.flatnonzero(np.isnan(asked[:, t]))
                step = max(1, ROW_CELLS // max(1, len(v)))
                for some in (ask[a:a + step] for a in range(0, len(ask) if len(v) else 0, step)):
                    i, j, _ = nearest(asked[some], v, k)
                    first = np.searchsorted(i, i)
                    total = np.concatenate([[0], np.cumsum(n[j])])
                    take = np.clip(k - (total[:-1] - total[first]), 0, n[j])
                    weight = np.bincount(i, take, len(some))
                    with np.errstate(invalid="ignore"):
                        out[some, t] = np.bincount(i, take * v[j, t], len(some)) / weight
            filled = np.full((len(gaps), width), np.nan)
            filled[gaps.is_valid().to_numpy(zero_copy_only=False)] = out[back.ravel()]
            flat = pa.array(filled.ravel(), from_pandas=True)             # NaN: no usable donor
            return pa.ListArray.from_arrays(pa.array(np.arange(len(gaps) + 1) * width, pa.int32()), flat)

        def fill(df: DataFrame, suffix: str = "") -> DataFrame:
            x = F.array(*[_value(c) for c in self.cols])
            out = df.withColumn("__imp", fills(F.when(F.exists(x, lambda v: v.isNull()), x)))
            return out.withColumns({f"{c}{suffix}": F.coalesce(_value(c), F.get("__imp", j), F.lit(self.means[c]).cast("double"))
                                    for j, c in enumerate(self.cols)}).drop("__imp")
        return fill

    def transform(self, df: DataFrame, id_col: str, suffix: str = "") -> DataFrame:
        """Every row with its gaps filled (NaN is a gap); a column without any training value stays null."""
        keyed = df.withColumn("__x", F.array(*[_value(c) for c in self.cols]))
        gap = F.exists("__x", lambda v: v.isNull())
        imputed = self._imputed(keyed.where(gap).select(F.col("__x").alias("x")).distinct())
        # rows without a gap have a null key: they match nothing and meet on no hot key
        out = keyed.withColumn("__k", F.when(gap, F.col("__x"))).join(
            imputed.withColumnRenamed("x", "__k"), "__k", "left")
        out = out.withColumns({f"{c}{suffix}": F.coalesce(_value(c), F.col(f"__imp_{j}"), F.lit(self.means[c]).cast("double"))
                               for j, c in enumerate(self.cols)})
        return out.select(*df.columns, *[c for c in out.columns if suffix and c in {f"{x}{suffix}" for x in self.cols}])


def orchestrated_fill(train: DataFrame, df: DataFrame, id_col: str, label: str, split: str,
                      knn_cols, mode_cols, zero_cols, k: int = 5) -> DataFrame:
    """IMP-12: KNN for ``knn_cols``, then class mode (overall mode on the
    unlabelled side, T14) for ``mode_cols``, then 0 for ``zero_cols``."""
    from sparkfeat.operators.clean import apply_class_fill, apply_fill, fill_constant, fit_modes
    knn = KnnImputer(knn_cols, k).fit(train)
    out = knn.transform(df, id_col)
    modes = fit_modes(train, (), mode_cols, by=label)  # class and overall modes, one aggregation
    overall = modes.pop(None)
    cast = int if dict(train.dtypes)[label] in ("int", "bigint", "smallint", "tinyint") else (lambda v: v)
    by_class = {cast(k): v for k, v in modes.items()}
    lab = apply_class_fill(out.filter(~F.col(split)), by_class, label)
    unl = apply_fill(out.filter(F.col(split)), overall)
    return fill_constant(lab.unionByName(unl), zero_cols, 0)
