"""Queries for row-wise and fitted numeric features (FEA-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.operators import clean as C
from sparkfeat.operators import features as X
from sparkfeat.plans.sqlkit import r6, with_profile
from sparkfeat.sources.fixtures import ORDER_SPEC, order_profile, train_rows

NUMS = ORDER_SPEC.numeric
POS = ("cnt_a", "cnt_n", "qty_r", "cnt_r")
TRANS = ("cnt_r", "cnt_a", "cnt_n", "qty_r", "total")

# Fixed value maps
ST1_MAP = {"F": 1.0, "O": 0.0}
URG_MAP = {"1-URGENT": 1.0, "5-LOW": 0.0}


def _st1():
    return C.map_values("st1", ST1_MAP, 0.5)


def _urg():
    return C.map_values("pri", URG_MAP, 0.5)


ST1_SQL = "CAST(CASE WHEN st1 = 'F' THEN 1.0 WHEN st1 = 'O' THEN 0.0 ELSE 0.5 END AS DOUBLE)"
URG_SQL = "CAST(CASE WHEN pri = '1-URGENT' THEN 1.0 WHEN pri = '5-LOW' THEN 0.0 ELSE 0.5 END AS DOUBLE)"


# ------------------------------------------------------------ SQL twins
def sql_count(cols):
    return "(" + " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols) + ")"


def sql_mean(cols):
    tot = " + ".join(f"coalesce(CAST({c} AS DOUBLE), CAST(0 AS DOUBLE))" for c in cols)
    return f"(({tot}) / CAST(nullif({sql_count(cols)}, 0) AS DOUBLE))"


def sql_std(cols):
    m = sql_mean(cols)
    ss = " + ".join(f"coalesce(({c} - {m}) * ({c} - {m}), CAST(0 AS DOUBLE))" for c in cols)
    n = sql_count(cols)
    return f"sqrt(CASE WHEN {n} - 1 > 0 THEN ({ss}) / CAST({n} - 1 AS DOUBLE) END)"


def _scores_sparkcols(df):
    """Stage 1: mapped flags; stage 2: scores (one select each)."""
    fs = X.FeatureSet()
    fs.add(st1_num=_st1(), urg=_urg())
    fs.add(pos_fixed=X.row_mean(POS, skip_null=False),
           neg_fixed=(F.col("cnt_r") + F.col("st1_num") * 10 + F.col("urg") * 10) / F.lit(3.0),
           pos=X.row_mean(POS), neg=X.row_mean(["cnt_r", "st1_num", "urg"]),
           consistency=X.row_std(POS))
    fs.add(balance=F.col("pos") - F.col("neg"))
    fs.add(balance_abs=F.abs("balance"))
    return fs.transform(df), ["pos_fixed", "neg_fixed", "pos", "neg", "balance", "balance_abs", "consistency"]


_SCORES_CTE = (
    f"s1 AS (SELECT *, {ST1_SQL} AS st1_num, {URG_SQL} AS urg FROM order_profile)",
    "s2 AS (SELECT *, (" + " + ".join(POS) + ") / CAST(4 AS DOUBLE) AS pos_fixed, "
    "(cnt_r + st1_num * 10 + urg * 10) / CAST(3 AS DOUBLE) AS neg_fixed, "
    f"{sql_mean(POS)} AS pos, {sql_mean(['cnt_r', 'st1_num', 'urg'])} AS neg, "
    f"{sql_std(POS)} AS consistency FROM s1)",
    "s3 AS (SELECT *, pos - neg AS balance, abs(pos - neg) AS balance_abs FROM s2)",
)


# -------------------------------------------------------------- FEA-1..4
def composite_scores(spark, sf):
    out, cols = _scores_sparkcols(order_profile(spark, sf))
    return out.select("id", *[F.round(c, 6).alias(c) for c in cols])


register("composite_scores", with_profile(*_SCORES_CTE) + "SELECT id, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ["pos_fixed", "neg_fixed", "pos", "neg", "balance", "balance_abs",
                                "consistency"]) + " FROM s3")(composite_scores)


# -------------------------------------------------------------- FEA-5/6
def _inter_exprs():
    return {
        "a_x_st1": F.col("cnt_a") * _st1(),
        "a_x_not_urg": F.col("cnt_a") * (F.lit(1.0) - _urg()),
        "q_x_n": F.col("qty_r") * F.col("cnt_n"),
        "n_x_a": F.col("cnt_n") * F.col("cnt_a"),
        "r_x_two_minus_urg": F.col("cnt_r") * (F.lit(2.0) - _urg()),
        "r_share": X.ratio("cnt_r", ["cnt_a", "cnt_n"]),
        "q_per_a": X.ratio("qty_r", ["cnt_a"]),
        "n_share": X.ratio("cnt_n", ["cnt_a", "cnt_n"]),
    }


def interactions(spark, sf):
    df = order_profile(spark, sf)
    ex = _inter_exprs()
    return df.select("id", *[F.round(v, 6).alias(k) for k, v in ex.items()])


register("interactions", with_profile() + "SELECT id, " + ", ".join([
    f"{r6(f'cnt_a * {ST1_SQL}')} AS a_x_st1",
    f"{r6(f'cnt_a * (1.0 - {URG_SQL})')} AS a_x_not_urg",
    f"{r6('qty_r * cnt_n')} AS q_x_n",
    f"{r6('cnt_n * cnt_a')} AS n_x_a",
    f"{r6(f'cnt_r * (2.0 - {URG_SQL})')} AS r_x_two_minus_urg",
    f"{r6('cnt_r / (cnt_a + cnt_n + 0.01)')} AS r_share",
    f"{r6('qty_r / (cnt_a + 0.01)')} AS q_per_a",
    f"{r6('cnt_n / (cnt_a + cnt_n + 0.01)')} AS n_share",
]) + " FROM order_profile")(interactions)


# -------------------------------------------------------------- FEA-7/8
def transforms(spark, sf):
    df = order_profile(spark, sf)
    mom = X.fit_moments(train_rows(df), TRANS)
    cols = []
    for c in TRANS:
        cols += [F.round(X.log1p(c), 6).alias(f"{c}_log"), X.safe_sqrt(c).alias(f"{c}_sqrt"),
                 F.round(X.signed_log(c), 6).alias(f"{c}_slog"),
                 F.round(X.zscore(c, mom), 6).alias(f"{c}_z")]
    return df.select("id", *cols)


register("transforms", with_profile(
    "mo AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in TRANS) +
    " FROM order_profile WHERE NOT is_test)") + "SELECT id, " + ", ".join(
    f"{r6(f'ln(1 + {c})')} AS {c}_log, CASE WHEN {c} >= 0 THEN sqrt({c}) END AS {c}_sqrt, "
    f"{r6(f'sign({c}) * ln(1 + abs({c}))')} AS {c}_slog, "
    f"{r6(f'({c} - m_{c}) / (s_{c} + 1e-8)')} AS {c}_z" for c in TRANS) +
    " FROM order_profile, mo")(transforms)


# ------------------------------------------------------------------ FEA-9
def pct_rank_avg(spark, sf):
    df = order_profile(spark, sf)
    out = X.pct_rank(df, NUMS, "id")
    return out.select("id", *[f"{c}_rank" for c in NUMS])


register("pct_rank_avg", with_profile() + "SELECT id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) "
    f"/ CAST(2 AS DOUBLE)) / count({c}) OVER () END AS {c}_rank" for c in NUMS) +
    " FROM order_profile")(pct_rank_avg)


# ----------------------------------------------------------------- FEA-10
def row_stats(spark, sf):
    df = order_profile(spark, sf)
    return df.select("id", F.round(X.row_mean(NUMS), 6).alias("feature_mean"),
                     F.round(X.row_std(NUMS), 6).alias("feature_std"),
                     X.row_max(NUMS).alias("feature_max"), X.row_min(NUMS).alias("feature_min"))


register("row_stats", with_profile() + f"SELECT id, {r6(sql_mean(NUMS))} AS feature_mean, "
         f"{r6(sql_std(NUMS))} AS feature_std, greatest({', '.join(NUMS)}) AS feature_max, "
         f"least({', '.join(NUMS)}) AS feature_min FROM order_profile")(row_stats)


# ------------------------------------------------------------ FEA-11..14
def balance_flags(spark, sf):
    scored_df, _ = _scores_sparkcols(order_profile(spark, sf))
    tr = train_rows(scored_df)
    mom = X.fit_moments(tr, ["cnt_r"])
    q = X.fit_quantiles(tr, ["cnt_r", "pos", "neg"], [0.9, 0.95])
    d = F.abs(F.col("pos") - F.col("neg"))
    amb = X.ambivalence(F.col("pos") - F.col("neg"))
    return scored_df.select(
        "id",
        F.round(amb, 6).alias("ambivert"), F.round(d, 6).alias("extreme"),
        X.above(amb, 0.5).cast("int").alias("ambivert_flag"),
        X.high_flag("cnt_r", mom, 2.0).alias("high_r"),
        (X.above("cnt_r", q[("cnt_r", 0.95)]) & X.at_most("cnt_a", 1) & X.at_most("cnt_n", 1))
        .cast("int").alias("pattern_in"),
        (X.at_least("cnt_a", 2) & X.at_least("cnt_n", 2) & X.at_least("qty_r", 2))
        .cast("int").alias("pattern_out"),
        (X.above("pos", q[("pos", 0.9)]) | X.above("neg", q[("neg", 0.9)])).cast("int").alias("either_extreme"),
    )


register("balance_flags", with_profile(
    *_SCORES_CTE,
    "tq AS (SELECT avg(cnt_r) + 2 * stddev_samp(cnt_r) AS hi_r, quantile_cont(cnt_r, 0.95) AS q_r, "
    "quantile_cont(pos, 0.9) AS q_pos, quantile_cont(neg, 0.9) AS q_neg FROM s3 WHERE NOT is_test)",
) + "SELECT id, " + ", ".join([
    f"{r6('1.0 / (1.0 + abs(pos - neg))')} AS ambivert",
    f"{r6('abs(pos - neg)')} AS extreme",
    "CAST(coalesce(1.0 / (1.0 + abs(pos - neg)) > 0.5, false) AS INTEGER) AS ambivert_flag",
    "CAST(coalesce(cnt_r > hi_r, false) AS INTEGER) AS high_r",
    "CAST(coalesce(cnt_r > q_r, false) AND coalesce(cnt_a <= 1, false) AND coalesce(cnt_n <= 1, false) AS INTEGER) AS pattern_in",
    "CAST(coalesce(cnt_a >= 2, false) AND coalesce(cnt_n >= 2, false) AND coalesce(qty_r >= 2, false) AS INTEGER) AS pattern_out",
    "CAST(coalesce(pos > q_pos, false) OR coalesce(neg > q_neg, false) AS INTEGER) AS either_extreme",
]) + " FROM s3, tq")(balance_flags)


# ----------------------------------------------------------------- FEA-15
def hybrid_features(spark, sf):
    """The phase-3 style feature set: inputs, scores and row stats, one plan."""
    df = order_profile(spark, sf)
    scored_df, cols = _scores_sparkcols(df)
    fs = X.FeatureSet().add(feature_mean=X.row_mean(NUMS), feature_std=X.row_std(NUMS),
                            feature_max=X.row_max(NUMS), feature_min=X.row_min(NUMS))
    out = fs.transform(scored_df)
    keep = cols + fs.names
    return out.select("id", "is_test", *NUMS, *[F.round(c, 6).alias(c) for c in keep])


register("hybrid_features", with_profile(*_SCORES_CTE) + "SELECT id, is_test, " + ", ".join(NUMS) + ", " +
         ", ".join(f"{r6(c)} AS {c}" for c in ["pos_fixed", "neg_fixed", "pos", "neg", "balance",
                                               "balance_abs", "consistency"]) +
         f", {r6(sql_mean(NUMS))} AS feature_mean, {r6(sql_std(NUMS))} AS feature_std, "
         f"{r6('greatest(' + ', '.join(NUMS) + ')')} AS feature_max, "
         f"{r6('least(' + ', '.join(NUMS) + ')')} AS feature_min FROM s3")(hybrid_features)
