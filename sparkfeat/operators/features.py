"""Row-wise and fitted numeric features (FEA-1..15).

Row-wise features are Column expressions, so a whole feature set is ONE
``select`` inside whole-stage codegen. Fitted features (z-score, quantile
flags, percentile rank) take their statistics from one aggregate over the
training rows and apply them as literals or a bounded lookup.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.ordered import cumulative, exact_quantiles, unpivot_numeric
from sparkfeat.session import written


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(cols) -> Column:
    cols = list(cols)
    return sum(cols[1:], cols[0])


# ------------------------------------------------------------- row statistics
def row_count(cols) -> Column:
    return _sum([_c(c).isNotNull().cast("int") for c in cols])


def row_mean(cols, skip_null: bool = True) -> Column:
    """FEA-1: mean of columns; skip_null=False → null if any input is null."""
    if not skip_null:
        return _sum([_c(c) for c in cols]) / F.lit(float(len(cols)))
    total = _sum([F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.try_divide(total, F.nullif(row_count(cols), F.lit(0)).cast("double"))


def row_std(cols, ddof: int = 1) -> Column:
    """FEA-4: row-wise std (two-pass, missing skipped), null under ddof+1 values."""
    m = row_mean(cols)
    ss = _sum([F.coalesce((_c(c) - m) * (_c(c) - m), F.lit(0.0)) for c in cols])
    den = F.nullif(row_count(cols) - F.lit(ddof), F.lit(0))
    return F.sqrt(F.when(den > 0, ss / den.cast("double")))


def row_max(cols) -> Column:
    return F.greatest(*[_c(c) for c in cols])


def row_min(cols) -> Column:
    return F.least(*[_c(c) for c in cols])


def ratio(num, dens, eps: float = 0.01) -> Column:
    """FEA-6: a / (b + c + eps)."""
    return _c(num) / (_sum([_c(d) for d in dens]) + F.lit(eps))


def log1p(c) -> Column:
    return F.log1p(_c(c))


def safe_sqrt(c) -> Column:
    """sqrt, null (not NaN) for negatives."""
    return F.when(_c(c) >= 0, F.sqrt(_c(c)))


def signed_log(c) -> Column:
    return F.signum(_c(c)) * F.log1p(F.abs(_c(c)))


def ambivalence(d) -> Column:
    """FEA-11: 1 / (1 + |d|)."""
    return F.lit(1.0) / (F.lit(1.0) + F.abs(_c(d)))


# ---------------------------------------------------------------- fitted stats
def fit_moments(df: DataFrame, cols) -> dict:
    """{col: (mean, sample std, population std)} in one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_samp(c).alias(f"s_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"p_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"], row[f"p_{c}"]) for c in cols}


def zscore(c, moments: dict, eps: float = 1e-8) -> Column:
    """FEA-8: (x − mean) / (sample std + eps)."""
    m, s, _ = moments[c]
    return (_c(c) - F.lit(m)) / (F.lit(s) + F.lit(eps))


def high_flag(c, moments: dict, k: float = 2.0) -> Column:
    """FEA-12: x > mean + k·std (sample); missing → 0, as are all values where the column has
    no moments (fewer than two values)."""
    m, s, _ = moments[c]
    if m is None or s is None:
        return F.lit(0)
    return F.coalesce(_c(c) > F.lit(m + k * s), F.lit(False)).cast("int")


def fit_quantiles(df: DataFrame, cols, probs) -> dict:
    return exact_quantiles(df, cols, probs)


def above(c, threshold) -> Column:
    """Comparison that treats missing as False (pandas semantics)."""
    return F.coalesce(_c(c) > F.lit(threshold), F.lit(False))


def at_most(c, threshold) -> Column:
    return F.coalesce(_c(c) <= F.lit(threshold), F.lit(False))


def at_least(c, threshold) -> Column:
    return F.coalesce(_c(c) >= F.lit(threshold), F.lit(False))


# ------------------------------------------------------------------ FEA-9
HOT = 1000      # a value that one row in so many has, or more, is frequent


def pct_rank(df: DataFrame, cols, id_col: str, suffix: str = "rank",
             fit_on: DataFrame | None = None) -> DataFrame:
    """Average-tie percentile rank (pandas ``rank(pct=True)``), exact, among the rows of
    ``fit_on`` (default: the rows themselves). A value that ``fit_on`` lacks gets the rank
    half-way between its neighbours', at most 1; a column without fitted values gives null.

    All columns in long form: distinct values to rank join the distinct fitted values with
    count 0 and are ordered among them by ``cumulative`` (no one-task window). The rows take the
    ranks of a column's frequent values (one row in ``HOT`` or more, so at most ``HOT`` values) by a
    broadcast; only the others are shuffled by value, so no task holds a column's rows of one
    value. Nulls are kept out. ``id_col`` need not be unique.
    """
    base = written(df.withColumn("__row", F.monotonically_increasing_id()), "ranked")
    long = unpivot_numeric(base, ["__row"], cols)
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("own")).withColumn("n", F.col("own"))
    if fit_on is not None:
        fitted = unpivot_numeric(fit_on, [], cols).groupBy("feature", "value").agg(F.count("*").alias("n"))
        none = F.lit(0).cast("bigint")
        counts = (fitted.withColumn("own", none).unionByName(counts.withColumn("n", none))
                  .groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("own").alias("own")))
    cum = cumulative(counts, ["feature"], "value", ["n", "own"])
    rank = F.least(F.try_divide((F.col("prev_n") + F.lit(1) + F.col("cum_n")) / F.lit(2.0), F.col("tot_n")), F.lit(1.0))
    table = written(cum.filter("own > 0").select(
        F.col("feature").alias("__f"), F.col("value").alias("__v"), F.when(F.col("tot_n") > 0, rank).alias("__pr"),
        (F.col("own") * F.lit(HOT) >= F.col("tot_own")).alias("__hot")), "ranks")
    hot, rest = (table.filter(c).drop("__hot") for c in ("__hot", "not __hot"))
    same = (F.col("feature") == F.col("__f")) & (F.col("value") == F.col("__v"))
    marked = long.join(F.broadcast(hot), same, "left")
    found = marked.filter("__f IS NOT NULL").select("__row", "feature", "__pr").unionByName(
        marked.filter("__f IS NULL").select("__row", "feature", "value").join(rest, same).select("__row", "feature", "__pr"))
    wide = found.groupBy("__row").agg(*[F.max(F.when(F.col("feature") == c, F.col("__pr"))).alias(f"{c}_{suffix}") for c in cols])
    return base.join(wide, "__row", "left").drop("__row")


# ------------------------------------------------------------------ FEA-15
@dataclass
class FeatureSet:
    """Ordered named expressions applied in one ``select`` (train and test).

    ``stages`` are lists of (name, Column); each stage may use the names of
    earlier stages, so common sub-expressions are computed once.
    """
    stages: list = field(default_factory=list)

    def add(self, **exprs) -> "FeatureSet":
        self.stages.append(list(exprs.items()))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for stage in self.stages:
            out = out.withColumns(dict(stage))
        return out

    @property
    def names(self) -> list[str]:
        return [n for st in self.stages for n, _ in st]
