"""Encoders (ENC-1..12).

Target statistics of all categorical columns come from ONE shuffle: the
columns are unpivoted to (feature, value) and grouped once (map-side
combined, so a hot category costs one partial row per task). Out-of-fold
values avoid k passes: with per-fold sums, the statistic *without* fold f is
total − fold. The global mean rides along as the pseudo feature ``__all__``.

Fitted state is a small table per (feature, value[, fold]) applied by
``lookup_join``; row-level randomness is hash-seeded (``gaussian``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import gaussian
from sparkfeat.functions.lookup import MAX_BROADCAST_ROWS, State, fit_state, load_fitted, lookup_join, save_fitted
from sparkfeat.functions.ordered import dense_codes
from sparkfeat.operators.folds import hash_fold, stratified_fold
from sparkfeat.session import cut_lineage

ALL = "__all__"


def _long_cats(df: DataFrame, cols, keep) -> DataFrame:
    """(keep..., feature, value) with the pseudo feature ``__all__`` for totals."""
    casted = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in cols],
                       F.lit("").alias(ALL))
    return casted.unpivot(list(keep), list(cols) + [ALL], "feature", "value")


def _when_chain(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


# ---------------------------------------------------------------- ENC-3 / 11
@dataclass
class SmoothModel:
    state: State  # feature, value, enc
    global_mean: float
    cols: tuple
    suffix: str

    def save(self, path: str) -> None:
        save_fitted(path, self.state.df.sparkSession, **vars(self))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "SmoothModel":
        return cls(**load_fitted(path, spark))

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        """ENC-11: real transform for unseen rows (unknown / null → global mean)."""
        out = df
        for c in self.cols:
            st = State(self.state.df.filter(F.col("feature") == c).drop("feature")
                       .withColumnRenamed("enc", f"__enc_{c}"), self.state.small)
            out = lookup_join(out, st, [(c, "value")], salt_col=id_col)
            out = out.withColumn(f"{c}_{self.suffix}",
                                 F.coalesce(F.col(f"__enc_{c}"), F.lit(self.global_mean))
                                 ).drop(f"__enc_{c}")
        return out


def fit_smooth(train: DataFrame, cols, label: str, alpha: float = 100.0,
               suffix: str = "te") -> SmoothModel:
    """ENC-3: ``(n·mean + α·g) / (n + α)`` per category; α=0 gives plain means."""
    long = _long_cats(train, cols, [label]).filter(F.col("value").isNotNull())
    stats = long.groupBy("feature", "value").agg(
        F.count("*").alias("n"), F.sum(label).cast("double").alias("s"))
    st = fit_state(stats)
    if st.small:
        tot = [r for r in st.rows if r.feature == ALL]
        g = (tot[0].s / tot[0].n) if tot else None
    else:
        r = st.df.filter(F.col("feature") == ALL).first()
        g = r.s / r.n if r else None
    a = F.lit(float(alpha))
    enc = F.when(F.col("n") + a == 0, F.lit(g)).otherwise(
        (F.col("s") + a * F.lit(g)) / (F.col("n") + a))
    table = st.df.filter(F.col("feature") != ALL).select("feature", "value", enc.alias("enc"))
    return SmoothModel(fit_state(table) if st.small else State(table, False), g,
                       tuple(cols), suffix)


# --------------------------------------------------------- ENC-4/5/6/8 (OOF)
def _oof_table(train: DataFrame, cols, label: str, fold_cols, alpha: float):
    """State (feature, value, fold_set, fold, enc) and {(fold_set, fold): g_f}."""
    keep = [label] + list(fold_cols)
    long = _long_cats(train, cols, keep).filter(F.col("value").isNotNull())
    stacked = long.select(
        "feature", "value", label,
        F.explode(F.array(*[F.struct(F.lit(i).alias("fs"), F.col(fc).alias("f"))
                            for i, fc in enumerate(fold_cols)])).alias("fsf"))
    stats = stacked.groupBy("feature", "value", F.col("fsf.fs").alias("fold_set"),
                            F.col("fsf.f").alias("fold")).agg(
        F.count("*").alias("n"), F.sum(label).cast("double").alias("s"))
    st = fit_state(stats)
    s_df = st.df
    wv = Window.partitionBy("feature", "value", "fold_set")
    s_df = s_df.withColumns({"tot_n": F.sum("n").over(wv), "tot_s": F.sum("s").over(wv)})
    # fold globals g_f from the pseudo feature
    glob = {}
    for r in (st.rows if st.small else s_df.filter(F.col("feature") == ALL).collect()):
        if r.feature == ALL:
            glob.setdefault(r.fold_set, {})[r.fold] = (r.n, r.s)
    gf = {}
    for fs, folds in glob.items():
        n_all = sum(v[0] for v in folds.values())
        s_all = sum(v[1] for v in folds.values())
        for f, (n, s) in folds.items():
            rest = n_all - n
            gf[(fs, f)] = (s_all - s) / rest if rest else None
    g_col = None
    for (fs, f), g in gf.items():
        cond = (F.col("fold_set") == fs) & (F.col("fold") == f)
        g_col = F.when(cond, F.lit(g)) if g_col is None else g_col.when(cond, F.lit(g))
    a = F.lit(float(alpha))
    den = F.col("tot_n") - F.col("n") + a
    enc = F.when(den == 0, g_col).otherwise((F.col("tot_s") - F.col("s") + a * g_col) / den)
    table = s_df.filter(F.col("feature") != ALL).select("feature", "value", "fold_set", "fold",
                                                         enc.alias("enc"))
    return (fit_state(table) if st.small else State(table, False)), gf


def oof_encode(train: DataFrame, cols, label: str, id_col: str, fold_cols,
               alpha: float = 100.0, names=None) -> DataFrame:
    """ENC-4/6/8: leave-fold-out smoothed means for every (column, fold set).

    ``names[(col, i)]`` is the output name for column ``col`` and fold set i.
    Null or unseen category → that fold's global mean (T7).
    """
    fold_cols = list(fold_cols)
    # fit and apply both read the rows: write them (with their fold windows)
    # once to the shared folder instead of recomputing the whole lineage
    train = cut_lineage(train)
    table, gf = _oof_table(train, cols, label, fold_cols, alpha)
    out = train
    for i, fc in enumerate(fold_cols):
        gcol = _when_chain(F.col(fc), {f: g for (fs, f), g in gf.items() if fs == i})
        for c in cols:
            name = names[(c, i)] if names else f"{c}_oof" + (f"_{i + 1}" if len(fold_cols) > 1 else "")
            st = State(table.df.filter((F.col("feature") == c) & (F.col("fold_set") == i))
                       .select("value", "fold", F.col("enc").alias("__enc")), table.small)
            out = lookup_join(out, st, [(c, "value"), (fc, "fold")], salt_col=id_col)
            out = out.withColumn(name, F.coalesce(F.col("__enc"), gcol)).drop("__enc")
    return out


def add_noise(df: DataFrame, cols, id_col: str, sigma: float = 0.01, seed: int = 42,
              suffix: str = "noise") -> DataFrame:
    """ENC-5: hash-seeded Gaussian noise (repeatable, partition-independent)."""
    return df.withColumns({
        f"{c}_{suffix}": F.col(c) + F.lit(float(sigma)) * gaussian(id_col, seed, c) for c in cols})


def multi_oof(train: DataFrame, cols, label: str, id_col: str, n_encodings: int = 3,
              k: int = 5, seed: int = 42, alpha: float = 100.0) -> DataFrame:
    """ENC-6: seeds s+1, s+2, … alternating stratified / plain folds (T5)."""
    df = train
    fold_cols = []
    for i in range(n_encodings):
        fc = f"__fold_{i}"
        if i % 2 == 0:
            df = stratified_fold(df, id_col, label, k, seed + 1 + i, fc)
        else:
            df = hash_fold(df, id_col, k, seed + 1 + i, fc)
        fold_cols.append(fc)
    names = {(c, i): f"{c}_cv_{i + 1}" for c in cols for i in range(n_encodings)}
    return oof_encode(df, cols, label, id_col, fold_cols, alpha, names).drop(*fold_cols)


def encode_all(train: DataFrame, cols, label: str, id_col: str, k: int = 5,
               seed: int = 42, alpha: float = 100.0, sigma: float = 0.01) -> DataFrame:
    """ENC-7: per column basic OOF, noisy OOF and two more fold sets (4 outputs)."""
    df = stratified_fold(train, id_col, label, k, seed, "__f0")
    df = stratified_fold(df, id_col, label, k, seed + 1, "__f1")
    df = hash_fold(df, id_col, k, seed + 2, "__f2")
    names = {}
    for c in cols:
        names[(c, 0)] = f"{c}_basic"
        names[(c, 1)] = f"{c}_cv_1"
        names[(c, 2)] = f"{c}_cv_2"
    out = oof_encode(df, cols, label, id_col, ["__f0", "__f1", "__f2"], alpha, names)
    out = add_noise(out, [f"{c}_basic" for c in cols], id_col, sigma, seed)
    out = out.withColumnsRenamed({f"{c}_basic_noise": f"{c}_noise" for c in cols})
    return out.drop("__f0", "__f1", "__f2")


# ------------------------------------------------------------------- ENC-9
def test_from_oof(train_encoded: DataFrame, test: DataFrame, cols, enc_names: dict,
                  id_col: str) -> DataFrame:
    """ENC-9: test value = mean of the train OOF values of its category."""
    # one aggregate for all columns; the global means are the pseudo category "no value"
    stacked = train_encoded.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"), F.col(enc_names[c]).alias("e"))
        for c in cols])).alias("r")).select("r.*")
    sums = stacked.groupBy("feature", "value").agg(F.sum("e").alias("s"), F.count("e").alias("n"))
    st = fit_state(sums)
    total = {r.feature: r.g for r in st.df.groupBy("feature").agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("g")).collect()}          # one row per column
    means = st.df.filter(F.col("value").isNotNull()).select(
        "feature", "value", F.try_divide("s", "n").alias("__m"))
    means = fit_state(means) if st.small else State(means, False)
    out = test
    for c in cols:
        sub = State(means.df.filter(F.col("feature") == c).drop("feature"), means.small)
        out = lookup_join(out, sub, [(c, "value")], salt_col=id_col)
        out = out.withColumn(enc_names[c], F.coalesce(F.col("__m"), F.lit(total.get(c)))).drop("__m")
    return out


# ------------------------------------------------------------------ ENC-10
NULL_KEY = "\u0000null"   # the category of missing values


def _shrunk(n: Column, s: Column, q: Column, m_y: Column, v_y: Column) -> Column:
    """λ·mean + (1-λ)·overall mean, λ = n·var_y / (n·var_y + var_cat), population variances."""
    mean_c = F.try_divide(s, n)
    var_c = F.try_divide(q, n) - mean_c * mean_c
    lam = v_y * n / (v_y * n + var_c)
    return F.when((n == 0) | (v_y * n + var_c == 0), m_y).otherwise(lam * mean_c + (F.lit(1.0) - lam) * m_y)


@dataclass
class BayesModel:
    state: State  # feature, value, enc
    mean: float
    cols: tuple
    suffix: str

    def save(self, path: str) -> None:
        save_fitted(path, self.state.df.sparkSession, **vars(self))

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "BayesModel":
        return cls(**load_fitted(path, spark))

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        """Full-data values for rows that were not trained on (unknown category → overall mean)."""
        out = df
        for c in self.cols:
            sub = State(self.state.df.filter(F.col("feature") == c).select(
                "value", F.col("enc").alias("__enc")), self.state.small)
            out = out.withColumn("__key", F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)))
            out = lookup_join(out, sub, [("__key", "value")], salt_col=id_col)
            out = out.withColumn(f"{c}_{self.suffix}", F.coalesce(F.col("__enc"), F.lit(self.mean))).drop("__enc", "__key")
        return out


def fit_empirical_bayes(train: DataFrame, cols, label: str, suffix: str = "eb") -> BayesModel:
    """ENC-10 for unseen rows: the same shrinkage fitted on all training rows."""
    long = _long_cats(train, cols, [label]).withColumn("value", F.coalesce(F.col("value"), F.lit(NULL_KEY)))
    y = F.col(label).cast("double")
    st = fit_state(long.groupBy("feature", "value").agg(
        F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")))
    tot = st.df.filter(F.col("feature") == ALL).first()
    mean = tot.s / tot.n if tot else None
    var = tot.q / tot.n - mean * mean if tot else None
    enc = _shrunk(F.col("n"), F.col("s"), F.col("q"), F.lit(mean), F.lit(var))
    table = st.df.filter(F.col("feature") != ALL).select("feature", "value", enc.alias("enc"))
    return BayesModel(fit_state(table) if st.small else State(table, False), mean, tuple(cols), suffix)


def empirical_bayes(train: DataFrame, cols, label: str, id_col: str, fold_col: str,
                    suffix: str = "eb") -> DataFrame:
    """ENC-10 for training rows: cross-fitted encoding with per-category shrinkage
    (``_shrunk``); null is a category. No row's value depends on its own fold's labels.
    """
    train = cut_lineage(train)  # read twice (fit, apply): materialise once
    long = _long_cats(train, cols, [label, fold_col]).withColumn(
        "value", F.coalesce(F.col("value"), F.lit(NULL_KEY)))
    y = F.col(label).cast("double")
    stats = long.groupBy("feature", "value", F.col(fold_col).alias("fold")).agg(
        F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    st = fit_state(stats)
    wv = Window.partitionBy("feature", "value")
    s_df = st.df.withColumns({"tot_n": F.sum("n").over(wv), "tot_s": F.sum("s").over(wv),
                              "tot_q": F.sum("q").over(wv)})
    glob = {r.fold: (r.n, r.s, r.q) for r in
            (st.rows if st.small else st.df.filter(F.col("feature") == ALL).collect())
            if r.feature == ALL}
    n_all = sum(v[0] for v in glob.values())
    s_all = sum(v[1] for v in glob.values())
    q_all = sum(v[2] for v in glob.values())
    ymean, yvar = {}, {}
    for f, (n, s, q) in glob.items():
        rn, rs, rq = n_all - n, s_all - s, q_all - q
        ymean[f] = rs / rn if rn else None
        yvar[f] = (rq / rn - (rs / rn) ** 2) if rn else None
    m_y = _when_chain(F.col("fold"), ymean)
    v_y = _when_chain(F.col("fold"), yvar)
    enc = _shrunk(F.col("tot_n") - F.col("n"), F.col("tot_s") - F.col("s"), F.col("tot_q") - F.col("q"), m_y, v_y)
    table = s_df.filter(F.col("feature") != ALL).select("feature", "value", "fold",
                                                         enc.alias("enc"))
    table_st = fit_state(table) if st.small else State(table, False)
    out = train
    gcol = _when_chain(F.col(fold_col), ymean)
    for c in cols:
        sub = State(table_st.df.filter(F.col("feature") == c).select(
            "value", "fold", F.col("enc").alias("__enc")), table_st.small)
        out = out.withColumn("__key", F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)))
        out = lookup_join(out, sub, [("__key", "value"), (fold_col, "fold")], salt_col=id_col)
        out = out.withColumn(f"{c}_{suffix}", F.coalesce(F.col("__enc"), gcol)).drop("__enc", "__key")
    return out


# ------------------------------------------------------------ ENC-1 / ENC-2
def fit_codes(df: DataFrame, cols, missing_text: str | None = "nan",
              max_rows: int = MAX_BROADCAST_ROWS) -> State:
    """ENC-1: code = position of the value in sorted text order.

    ``missing_text`` makes null a category spelled like that (the library
    behaviour of encoding ``astype(str)``); None keeps null as null (ENC-2).
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    if missing_text is not None:
        long = long.withColumn("value", F.coalesce("value", F.lit(missing_text)))
    else:
        long = long.filter(F.col("value").isNotNull())
    distinct = long.distinct()
    st = fit_state(distinct, max_rows)
    if st.small:
        w = Window.partitionBy("feature").orderBy("value")
        return fit_state(st.df.withColumn("code", (F.dense_rank().over(w) - 1).cast("int")))
    # many distinct values: bucketed exact ranking, never one task per column
    return State(cut_lineage(dense_codes(st.df, "feature", "value")), False)


def apply_codes(df: DataFrame, state: State, cols, id_col: str, missing_text: str | None = "nan",
                suffix: str = "code") -> DataFrame:
    out = df
    for c in cols:
        sub = State(state.df.filter(F.col("feature") == c).select(
            "value", F.col("code").alias("__code")), state.small)
        key = F.col(c).cast("string")
        if missing_text is not None:
            key = F.coalesce(key, F.lit(missing_text))
        out = out.withColumn("__key", key)
        out = lookup_join(out, sub, [("__key", "value")], salt_col=id_col)
        out = out.withColumnRenamed("__code", f"{c}_{suffix}").drop("__key")
    return out


# ------------------------------------------------------------------ ENC-12
def fit_standard(train: DataFrame, cols) -> dict:
    """ENC-12: mean and population std per column (std 0 → scale 1)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] else 1.0) for c in cols}


def apply_standard(df: DataFrame, params: dict, suffix: str = "std") -> DataFrame:
    return df.withColumns({f"{c}_{suffix}": (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, (m, s) in params.items()})
