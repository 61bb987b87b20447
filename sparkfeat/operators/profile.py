"""Profiling and statistics (AGG-1..18, SRT-1..3).

Each report is one or two distributed aggregates over all columns at once
(columns are unpivoted, never looped over with one job each). Order
statistics use ``exact_quantiles`` / ``cumulative`` (bucketed, exact).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.kolmogorov import ks_exact_p
from sparkfeat.functions.ordered import cumulative, exact_quantiles, quantile_rows, unpivot_numeric
from sparkfeat.operators.gram import correlations


def _stack(row_df: DataFrame, cols, stats) -> DataFrame:
    """One wide aggregate row with ``<stat>__<col>`` fields → (feature, stats...)."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"),
                             *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols])
    return row_df.select(F.explode(arr).alias("r")).select("r.*")


# ------------------------------------------------------------------ AGG-1
def describe_numeric(df: DataFrame, cols) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"count__{c}"), F.avg(c).alias(f"mean__{c}"),
                 F.stddev_samp(c).alias(f"std__{c}"), F.min(c).cast("double").alias(f"min__{c}"),
                 F.max(c).cast("double").alias(f"max__{c}")]
    base = _stack(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qrows = [(c, *(q.get((c, p)) for p in (0.25, 0.5, 0.75))) for c in cols]
    qdf = df.sparkSession.createDataFrame(qrows, "feature string, q25 double, q50 double, q75 double")
    return base.join(F.broadcast(qdf), "feature")


# ------------------------------------------------------------------ AGG-2
def describe_categorical(df: DataFrame, cols) -> DataFrame:
    """count, unique, top (ties → lowest), freq per column."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value").filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("n"))
    found = counts.groupBy("feature").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("v"))).alias("b")
    ).select("feature", "count", "unique", F.col("b.v").alias("top"), (-F.col("b.neg")).alias("freq"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")   # all-null columns stay, with count 0
    return names.join(found, "feature", "left").fillna(0, subset=["count", "unique"])


# ------------------------------------------------------------------ AGG-3
def value_counts(df: DataFrame, cols) -> DataFrame:
    """(feature, value, n, share); missing kept as its own (null) value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    total = df.count()
    return long.groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn(
        "share", F.col("n") / F.lit(float(total)))


# ------------------------------------------------------------------ AGG-4
def duplicate_report(df: DataFrame, id_col: str, feature_cols) -> DataFrame:
    """(metric, value): rows, duplicated feature rows, duplicated ids, id range."""
    per_row = df.groupBy(*feature_cols).agg(F.count("*").alias("k"))
    dup_rows = per_row.agg(F.sum(F.col("k") - 1).cast("bigint").alias("dup_rows"))
    ids = df.agg(F.count("*").alias("n_rows"),
                 (F.count("*") - F.count_distinct(id_col)).alias("dup_ids"),
                 F.min(id_col).cast("bigint").alias("id_min"), F.max(id_col).cast("bigint").alias("id_max"))
    a = ids.unpivot([], ["n_rows", "dup_ids", "id_min", "id_max"], "metric", "value")
    b = dup_rows.unpivot([], ["dup_rows"], "metric", "value")
    return a.unionByName(b)


# ------------------------------------------------------------------ AGG-5
def crosstab_share(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Cross-tab normalised by row, shown for a fixed value list. ``n`` counts the row's rows
    with any value, listed or not; a row with missing values only has n 0 and shares 0."""
    counts = df.groupBy(row).agg(F.count(col).alias("n"),
                                 *[F.count_if(F.col(col) == v).alias(f"__n{i}") for i, v in enumerate(values)])
    return counts.select(row, "n", *[F.coalesce(F.try_divide(F.col(f"__n{i}"), F.col("n")), F.lit(0.0)).alias(f"share_{v}")
                                     for i, v in enumerate(values)])


# ------------------------------------------------------------------ AGG-6/7
def outlier_report(df: DataFrame, cols, label: str, ks=(2.0, 3.0)) -> DataFrame:
    """|z| > k counts (population std, missing skipped) and label lift of the
    high (z > k0) subset versus the whole table."""
    mom = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    aggs = [F.avg(label).alias("base_rate")]
    for c in cols:
        m, s = mom[f"m_{c}"], mom[f"s_{c}"]
        z = F.try_divide(F.col(c) - F.lit(m).cast("double"), F.lit(s).cast("double"))   # null on a constant column
        for k in ks:
            aggs.append(F.count_if(F.abs(z) > k).alias(f"out{int(k)}__{c}"))
        hi = z > ks[0]
        aggs.append(F.count_if(hi).alias(f"high__{c}"))
        aggs.append(F.avg(F.when(hi, F.col(label))).alias(f"rate__{c}"))
    row = df.agg(*aggs)
    stats = [f"out{int(k)}" for k in ks] + ["high", "rate"]
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{s}__{c}").alias(s) for s in stats],
                             F.col("base_rate")) for c in cols])
    out = row.select(F.explode(arr).alias("r")).select("r.*")
    return out.withColumn("lift", F.col("rate") / F.col("base_rate"))


# ------------------------------------------------------------------ AGG-8..10
def corr_long(df: DataFrame, cols, threshold: float = 0.9) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete), ``high`` above the threshold."""
    return correlations(df, cols).withColumn("high", F.coalesce(F.abs("corr") > threshold, F.lit(False)))


# ------------------------------------------------------------------ AGG-11
EXACT_KS = 10_000      # usual size of the larger sample up to which the p-value is exact


def ks_two_sample(df: DataFrame, cols, side_col: str, terms: int = 100, exact_up_to: int = 0) -> DataFrame:
    """Two-sample KS statistic D per column and its two-sided p-value.

    D = max over distinct values of |F_a(v) − F_b(v)| with inclusive ECDFs,
    from distinct-value counts ranked by ``cumulative`` (no full sort, no
    one-task window). With at most ``exact_up_to`` values on either side the p-value is exact
    (``ks_exact_p``, one column a row; ``EXACT_KS`` is the usual choice); beyond it, and by default, it is asymptotic,
    p = Q_KS(sqrt(n_a·n_b/(n_a+n_b))·D).
    """
    long = unpivot_numeric(df, [side_col], cols)
    counts = long.groupBy("feature", "value").agg(
        F.count_if(~F.col(side_col)).alias("na"), F.count_if(F.col(side_col)).alias("nb"))
    cum = cumulative(counts, ["feature"], "value", ["na", "nb"])
    small = (F.col("tot_na").between(1, exact_up_to)) & (F.col("tot_nb").between(1, exact_up_to))
    d = cum.groupBy("feature").agg(
        F.max(F.abs(F.try_divide("cum_na", "tot_na") - F.try_divide("cum_nb", "tot_nb"))).alias("d"),
        F.max("tot_na").alias("n_a"), F.max("tot_nb").alias("n_b"),
        F.max(F.when(small, F.abs(F.col("cum_na") * F.col("tot_nb") - F.col("cum_nb") * F.col("tot_na")))).alias("reach"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d")
    js = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(js, F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0)
                         * F.exp(F.lit(-2.0) * j * j * lam * lam))
    p = F.when(F.col("d").isNull(), F.lit(None)).when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0)))
    rows = d.select("feature", "n_a", "n_b", "d", "reach", p.alias("p_value"))

    def exact(batches):
        for batch in batches:
            out = [p if r is None else ks_exact_p(a, b, r) for a, b, r, p in zip(
                *(batch.column(c).to_pylist() for c in ("n_a", "n_b", "reach", "p_value")))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.float64())], names=["feature", "n_a", "n_b", "d", "p_value"])
    return rows.mapInArrow(exact, "feature string, n_a long, n_b long, d double, p_value double")


# ------------------------------------------------------------------ AGG-12
def histogram(df: DataFrame, cols, by, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] of each column; counts per group and bin."""
    mm = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    parts = []
    for c in cols:
        lo, hi = mm[f"lo_{c}"], mm[f"hi_{c}"]
        width = (hi - lo) if hi is not None and hi != lo else None
        b = (F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width) * F.lit(float(bins))), F.lit(bins - 1))
             if width else F.lit(0)).cast("int")
        b = F.when(F.col(c).isNotNull(), b)  # least() skips nulls; keep missing out
        parts.append(F.struct(F.lit(c).alias("feature"), b.alias("bin")))
    long = df.select(*by, F.explode(F.array(*parts)).alias("fb")).select(
        *by, "fb.feature", "fb.bin").filter(F.col("bin").isNotNull())
    return long.groupBy("feature", *by, "bin").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ AGG-13
def five_number(df: DataFrame, cols, by: str) -> DataFrame:
    """min, quartiles, max and 1.5·IQR fences per column and group."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    q = quantile_rows(df, cols, list(probs.values()), by=by).groupBy(F.col("feature").alias("__f"), F.col("grp").alias("__g")).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in probs.items()])
    mm = unpivot_numeric(df, [by], cols).groupBy("feature", F.col(by).cast("string").alias("grp")).agg(
        F.min("value").alias("min"), F.max("value").alias("max"))
    out = mm.join(q, (F.col("feature") == F.col("__f")) & F.col("grp").eqNullSafe(F.col("__g"))).drop("__f", "__g")
    iqr = F.col("q75") - F.col("q25")
    return out.withColumns({"lower_fence": F.col("q25") - F.lit(1.5) * iqr,
                            "upper_fence": F.col("q75") + F.lit(1.5) * iqr})


# ------------------------------------------------------------------ AGG-14
def family_stats(df: DataFrame, cols) -> DataFrame:
    """Zero share, mean, std, max per column of a family."""
    long = unpivot_numeric(df, [], cols)
    return long.groupBy("feature").agg(
        F.avg((F.col("value") == 0).cast("double")).alias("zero_share"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("max"))


# ------------------------------------------------------------------ AGG-17
def prediction_summary(pred: DataFrame, pred_col: str, conf_col: str) -> DataFrame:
    """Class counts, share and mean confidence (one row per class)."""
    by_class = pred.groupBy(pred_col).agg(F.count("*").alias("n"), F.avg(conf_col).alias("mean_conf"))
    return by_class.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


# ------------------------------------------------------------------ AGG-18
def flag_rules(metrics: DataFrame, rules: dict) -> DataFrame:
    """metrics(metric, value) + {metric: (op, threshold)} → issue flags."""
    expr = None
    thr = None
    for m, (op, t) in rules.items():
        cond = F.col("metric") == m
        test = {">": F.col("value") > t, "<": F.col("value") < t, ">=": F.col("value") >= t}[op]
        expr = F.when(cond, test) if expr is None else expr.when(cond, test)
        thr = F.when(cond, F.lit(float(t))) if thr is None else thr.when(cond, F.lit(float(t)))
    return metrics.withColumns({"threshold": thr, "issue": F.coalesce(expr, F.lit(False))})


def kolmogorov_sf(lam: float, terms: int = 100) -> float:
    """Driver twin of the p-value series (tests)."""
    if lam < 0.2:
        return 1.0
    s = sum(((-1.0) ** (j - 1)) * math.exp(-2.0 * j * j * lam * lam) for j in range(1, terms + 1))
    return min(max(2.0 * s, 0.0), 1.0)


def density_grid(hist: DataFrame, points: int = 31) -> DataFrame:
    """AGG-12 density curve: a Gaussian kernel sum over binned counts,
    evaluated on an even grid per (feature, group). Input: (feature, grp, lo,
    hi, bin, n) with ``bins`` equal-width bins; the per-group bin list has at
    most ``bins`` entries, so it is gathered with ``collect_list``.

    Bandwidth: Silverman's rule on the binned data, h = 1.06 · σ · N^(-1/5).
    """
    per = hist.groupBy("feature", "grp", "lo", "hi", "bins").agg(
        F.collect_list(F.struct("bin", "n")).alias("hb"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    centre = lambda b: F.col("lo") + (b["bin"] + F.lit(0.5)) * width
    n_tot = F.aggregate("hb", F.lit(0.0), lambda acc, b: acc + b["n"])
    mean = F.aggregate("hb", F.lit(0.0), lambda acc, b: acc + b["n"] * centre(b)) / n_tot
    var = F.aggregate("hb", F.lit(0.0), lambda acc, b: acc + b["n"] * (centre(b) - mean) * (centre(b) - mean)) / n_tot
    h = F.lit(1.06) * F.sqrt(var) * F.pow(n_tot, F.lit(-0.2))
    per = per.withColumns({"__n": n_tot, "__h": h})
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    step = (F.col("hi") - F.col("lo")) / F.lit(points - 1)

    def dens(i):
        x = F.col("lo") + i * step
        return F.struct(i.alias("point"), x.alias("x"), F.try_divide(F.aggregate(
            "hb", F.lit(0.0),
            lambda acc, b: acc + b["n"] * F.exp(F.lit(-0.5) * F.pow(F.try_divide(x - centre(b), F.col("__h")), 2))),
            F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi))).alias("density"))

    return per.select("feature", "grp", F.explode(F.transform(grid, dens)).alias("d")).select(
        "feature", "grp", "d.point", "d.x", "d.density")
