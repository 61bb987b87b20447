"""Queries for ensembles, evaluation and pseudo-labels on the score table
(ENS-1/6/7/8, EVL-1..4, PSL-1/3, AGG-17, SRT-2/3, SNK-4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.operators import ensemble as EN
from sparkfeat.operators import pseudo as PS
from sparkfeat.operators.clean import confidence
from sparkfeat.plans.sqlkit import r6
from sparkfeat.session import checkpoint_dir
from sparkfeat.sources import sinks
from sparkfeat.sources.fixtures import MODELS, scored, scored_sql

SEED = 42
M = list(MODELS)
MEAN_SQL = "(" + " + ".join(f"p_{m}" for m in M) + f") / CAST({len(M)} AS DOUBLE)"


def _mean_col():
    return sum((F.col(f"p_{m}") for m in M[1:]), F.col(f"p_{M[0]}")) / F.lit(float(len(M)))


def _wide(spark, sf, test: bool):
    s = scored(spark, sf).filter(F.col("is_test") == test)
    return EN.pivot_scores(s, M, keep=("label",))


def _sql(*ctes):
    return "WITH " + ",\n".join([scored_sql().strip()] + [c.strip() for c in ctes]) + "\n"


def _wide_sql(test: bool):
    cond = "is_test" if test else "NOT is_test"
    return ("wide AS (SELECT id, label, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN p END) AS p_{m}" for m in M) +
            f" FROM scored WHERE {cond} GROUP BY id, label)")


def _weights_sql(n, salt, name="wt"):
    raws = ", ".join(
        f"CAST('0x' || substr(md5('{SEED}|{salt}|' || t || '|{m}'), 1, 8) AS BIGINT) AS r_{m}" for m in M)
    tot = " + ".join(f"r_{m}" for m in M)
    return (f"{name}_raw AS (SELECT CAST(t AS INTEGER) AS trial, {raws} FROM range({n}) tt(t)),\n"
            f"{name} AS (SELECT trial, " + ", ".join(f"r_{m} / ({tot}) AS w_{m}" for m in M) + f" FROM {name}_raw)")


def _score_sql(prefix=""):
    return " + ".join(f"{prefix}w_{m} * p_{m}" for m in M)


# ------------------------------------------------------------------ ENS-1
def soft_vote(spark, sf):
    w = _wide(spark, sf, False)
    p = _mean_col()
    # same expression on both sides: bit-identical, so no rounding needed
    return w.select("id", "label", p.alias("p_mean"), (p > 0.5).cast("int").alias("pred"))


register("soft_vote", _sql(_wide_sql(False)) +
         f"SELECT id, label, {MEAN_SQL} AS p_mean, CAST({MEAN_SQL} > 0.5 AS INTEGER) AS pred FROM wide")(soft_vote)


# ------------------------------------------------------------------ ENS-6
def weight_search(spark, sf):
    out = EN.weight_search(_wide(spark, sf, False), M, 100, SEED)
    return out.select("trial", *[F.round(f"w_{m}", 6).alias(f"w_{m}") for m in M],
                      F.round("acc", 6).alias("acc"), "n")


register("weight_search", _sql(_wide_sql(False), _weights_sql(100, "w")) +
         "SELECT trial, " + ", ".join(f"{r6(f'w_{m}')} AS w_{m}" for m in M) +
         f", {r6(f'avg(CAST(CAST({_score_sql()} > 0.5 AS INTEGER) = label AS DOUBLE))')} AS acc, count(*) AS n "
         "FROM wt, wide GROUP BY ALL")(weight_search)


def best_weights(spark, sf):
    out = EN.weight_search(_wide(spark, sf, False), M, 100, SEED)
    best = EN.best_trial(out)
    return best.select("trial", F.round("acc", 6).alias("acc"))


register("best_weights", _sql(_wide_sql(False), _weights_sql(100, "w")) +
         f"SELECT trial, {r6('acc')} AS acc FROM (SELECT trial, avg(CAST(CAST({_score_sql()} > 0.5 AS INTEGER) = label "
         "AS DOUBLE)) AS acc FROM wt, wide GROUP BY trial) ORDER BY acc DESC, trial LIMIT 1")(best_weights)


# ------------------------------------------------------------------ ENS-7/8
RANGE_TRIALS = 50
MIN_ROWS = 10


def _range_fit(spark, sf):
    w = _wide(spark, sf, False).withColumn("rng", EN.range_of(_mean_col()))
    search = EN.weight_search(w, M, RANGE_TRIALS, SEED, by="rng", salt="range")
    best = EN.best_trial(search, by="rng")
    fit = search.join(best.select("rng", "trial"), ["rng", "trial"])
    eq = 1.0 / len(M)
    # ranges with too few rows fall back to equal weights
    return fit.select("rng", "n", F.when(F.col("n") < MIN_ROWS, -1).otherwise(F.col("trial")).alias("trial"),
                      *[F.when(F.col("n") < MIN_ROWS, eq).otherwise(F.col(f"w_{m}")).alias(f"w_{m}") for m in M],
                      "acc")


def range_weights(spark, sf):
    fit = _range_fit(spark, sf)
    return fit.select("rng", "n", "trial", *[F.round(f"w_{m}", 6).alias(f"w_{m}") for m in M],
                      F.round("acc", 6).alias("acc"))


_RANGE_SQL_CTES = (
    _wide_sql(False).replace("wide AS", "wide0 AS"),
    f"wide AS (SELECT *, CASE WHEN {MEAN_SQL} <= 0.3 THEN 'low' WHEN {MEAN_SQL} <= 0.7 THEN 'mid' ELSE 'high' END AS rng FROM wide0)",
    _weights_sql(RANGE_TRIALS, "range"),
    f"s AS (SELECT rng, trial, " + ", ".join(f"w_{m}" for m in M) +
    f", count(*) AS n, avg(CAST(CAST({_score_sql()} > 0.5 AS INTEGER) = label AS DOUBLE)) AS acc FROM wt, wide GROUP BY ALL)",
    "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rng ORDER BY acc DESC, trial) AS rk FROM s) WHERE rk = 1)",
    "fit AS (SELECT rng, n, CASE WHEN n < 10 THEN -1 ELSE trial END AS trial, " + ", ".join(
        f"CASE WHEN n < 10 THEN {1.0 / len(M)!r} ELSE w_{m} END AS w_{m}" for m in M) + ", acc FROM b)",
)
register("range_weights", _sql(*_RANGE_SQL_CTES) + "SELECT rng, n, trial, " + ", ".join(
    f"{r6(f'w_{m}')} AS w_{m}" for m in M) + f", {r6('acc')} AS acc FROM fit")(range_weights)


def range_apply(spark, sf):
    fit = _range_fit(spark, sf)
    rows = {r.rng: [r[f"w_{m}"] for m in M] for r in fit.collect()}  # ≤ 3 rows
    test = _wide(spark, sf, True).withColumn("rng", EN.range_of(_mean_col()))
    expr = None
    for rng, ws in rows.items():
        sc = EN.weighted_score(ws, M)
        expr = F.when(F.col("rng") == rng, sc) if expr is None else expr.when(F.col("rng") == rng, sc)
    test = test.withColumn("p_final", expr)
    return test.select("id", "rng", "p_final",
                       (F.col("p_final") > 0.5).cast("int").alias("pred"))


register("range_apply", _sql(*_RANGE_SQL_CTES, _wide_sql(True).replace("wide AS", "tw0 AS"),
                             f"tw AS (SELECT *, CASE WHEN {MEAN_SQL} <= 0.3 THEN 'low' WHEN {MEAN_SQL} <= 0.7 "
                             "THEN 'mid' ELSE 'high' END AS rng FROM tw0)") +
         f"SELECT id, tw.rng, {_score_sql('fit.')} AS p_final, CAST({_score_sql('fit.')} > 0.5 AS INTEGER) AS pred "
         "FROM tw JOIN fit ON tw.rng = fit.rng")(range_apply)


# ------------------------------------------------------------------ EVL-1/2, SRT-2
def _with_vote(spark, sf):
    s = scored(spark, sf).filter(~F.col("is_test"))
    w = EN.pivot_scores(s, M, keep=("label",)).join(
        s.select("id", "fold").distinct(), "id")
    vote = w.select("id", F.lit("vote").alias("model"), _mean_col().alias("p"), "label", "fold")
    return s.select("id", "model", "p", "label", "fold").unionByName(vote)


def _vote_sql():
    return (_wide_sql(False),
            "folds AS (SELECT DISTINCT id, fold FROM scored WHERE NOT is_test)",
            f"allp AS (SELECT id, model, p, label, fold FROM scored WHERE NOT is_test UNION ALL "
            f"SELECT wide.id, 'vote', {MEAN_SQL}, label, fold FROM wide JOIN folds USING (id))",
            "fa AS (SELECT model, fold, count(*) AS n, avg(CAST(CAST(p > 0.5 AS INTEGER) = label AS DOUBLE)) AS acc "
            "FROM allp GROUP BY model, fold)",
            "cv AS (SELECT model, avg(acc) AS mean_acc, stddev_pop(acc) AS std_acc, sum(acc * n) / sum(n) AS pooled_acc "
            "FROM fa GROUP BY model)")


def cv_table(spark, sf):
    out = EN.cv_summary(_with_vote(spark, sf))
    return out.select("model", *[F.round(c, 6).alias(c) for c in
                                 ["mean_acc", "std_acc", "pooled_acc", "ci_lo", "ci_hi"]])


register("cv_table", _sql(*_vote_sql()) +
         f"SELECT model, {r6('mean_acc')} AS mean_acc, {r6('std_acc')} AS std_acc, {r6('pooled_acc')} AS pooled_acc, "
         f"{r6('mean_acc - 2 * std_acc')} AS ci_lo, {r6('mean_acc + 2 * std_acc')} AS ci_hi FROM cv")(cv_table)


def leaderboard(spark, sf):
    out = EN.leaderboard(EN.cv_summary(_with_vote(spark, sf)))
    return out.select("model", F.round("mean_acc", 6).alias("mean_acc"), "rank")


register("leaderboard", _sql(*_vote_sql()) +
         f"SELECT model, {r6('mean_acc')} AS mean_acc, CAST(row_number() OVER (ORDER BY mean_acc DESC, model) AS INTEGER) AS rank "
         "FROM cv")(leaderboard)


def best_model(spark, sf):
    cv = EN.cv_summary(_with_vote(spark, sf))
    return cv.agg(F.max_by("model", F.struct("mean_acc", F.col("model"))).alias("model"),
                  F.round(F.max("mean_acc"), 6).alias("mean_acc"))


register("best_model", _sql(*_vote_sql()) +
         f"SELECT arg_max(model, (mean_acc, model)) AS model, {r6('max(mean_acc)')} AS mean_acc FROM cv")(best_model)


# ------------------------------------------------------------------ EVL-3
VARIANTS = {"m1": ["m1"], "vote_m1_m2": ["m1", "m2"], "vote_all": M}


def ab_compare(spark, sf):
    w = _wide(spark, sf, False)
    aggs = []
    for name, ms in VARIANTS.items():
        p = sum((F.col(f"p_{m}") for m in ms[1:]), F.col(f"p_{ms[0]}")) / F.lit(float(len(ms)))
        aggs.append(F.avg(EN.correct(p)).alias(name))
    row = w.agg(*aggs)
    long = row.unpivot([], list(VARIANTS), "variant", "acc")
    base = F.first(F.when(F.col("variant") == "m1", F.col("acc")), ignorenulls=True).over(
        Window.partitionBy())
    out = long.withColumn("base", base).withColumn("delta", F.col("acc") - F.col("base"))
    return out.select("variant", F.round("acc", 6).alias("acc"), F.round("delta", 6).alias("delta"),
                      F.round(F.col("delta") / F.col("base") * 100, 6).alias("pct"),
                      EN.status_band(F.col("delta")).alias("status"))


def _ab_sql():
    accs = []
    for name, ms in VARIANTS.items():
        p = "(" + " + ".join(f"p_{m}" for m in ms) + f") / CAST({len(ms)} AS DOUBLE)"
        accs.append(f"SELECT '{name}' AS variant, avg(CAST(CAST({p} > 0.5 AS INTEGER) = label AS DOUBLE)) AS acc FROM wide")
    return _sql(_wide_sql(False), "a AS (" + " UNION ALL ".join(accs) + ")",
                "b AS (SELECT acc AS base FROM a WHERE variant = 'm1')") + (
        f"SELECT variant, {r6('acc')} AS acc, {r6('acc - base')} AS delta, {r6('(acc - base) / base * 100')} AS pct, "
        "CASE WHEN acc - base >= 0.005 THEN 'significant' WHEN acc - base >= 0.003 THEN 'moderate' "
        "WHEN acc - base > 0 THEN 'slight' ELSE 'none' END AS status FROM a, b")


register("ab_compare", _ab_sql())(ab_compare)


# ------------------------------------------------------------------ EVL-4
def confusion(spark, sf):
    w = _wide(spark, sf, False).withColumn("pred", (_mean_col() > 0.5).cast("int"))
    out = EN.confusion(w)
    return out.select("cls", "support", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1"]])


register("confusion", _sql(
    _wide_sql(False),
    f"pr AS (SELECT label, CAST({MEAN_SQL} > 0.5 AS INTEGER) AS pred FROM wide)",
    "per AS (SELECT CAST(c.label AS VARCHAR) AS cls, c.support, "
    "coalesce(CAST(count_if(pr.label = c.label AND pr.pred = c.label) AS DOUBLE) / nullif(count_if(pr.pred = c.label), 0), 0.0) AS precision, "
    "CAST(count_if(pr.label = c.label AND pr.pred = c.label) AS DOUBLE) / c.support AS recall "
    "FROM (SELECT label, count(*) AS support FROM pr GROUP BY label) c, pr GROUP BY c.label, c.support)",
    "per2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per)",
) + f"""SELECT cls, support, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM per2
UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), {r6('avg(precision)')}, {r6('avg(recall)')}, {r6('avg(f1)')} FROM per2
UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), {r6('sum(support * precision) / sum(support)')},
  {r6('sum(support * recall) / sum(support)')}, {r6('sum(support * f1) / sum(support)')} FROM per2""")(confusion)


def confusion_matrix(spark, sf):
    w = _wide(spark, sf, False).withColumn("pred", (_mean_col() > 0.5).cast("int"))
    return EN.confusion_counts(w)


register("confusion_matrix", _sql(_wide_sql(False)) +
         f"SELECT label, CAST({MEAN_SQL} > 0.5 AS INTEGER) AS pred, count(*) AS n FROM wide GROUP BY ALL")(confusion_matrix)


# ------------------------------------------------------------------ PSL-1 / SRT-3
def pseudo_one_sided(spark, sf):
    n_train = scored(spark, sf).filter(~F.col("is_test") & (F.col("model") == M[0])).count()
    test = _wide(spark, sf, True).withColumn("p", _mean_col())
    out = PS.one_sided(test, n_train, 0.85, 0.3, 0.8)
    # identical expressions on both sides (bit-identical doubles): no rounding
    return out.select("id", "label", "confidence", "weight")


register("pseudo_one_sided", _sql(
    _wide_sql(True),
    f"c AS (SELECT id, {MEAN_SQL} AS p, greatest({MEAN_SQL}, 1.0 - {MEAN_SQL}) AS confidence FROM wide)",
    "nt AS (SELECT count(*) AS n FROM scored WHERE NOT is_test AND model = 'm1')",
) + "SELECT id, CAST(p > 0.5 AS INTEGER) AS label, confidence, confidence * 0.8 AS weight "
    "FROM (SELECT c.*, row_number() OVER (ORDER BY confidence DESC, id) AS rk FROM c WHERE confidence >= 0.85), nt "
    "WHERE rk <= CAST(floor(nt.n * 0.3) AS BIGINT)")(pseudo_one_sided)


# ------------------------------------------------------------------ PSL-3
def pseudo_two_sided(spark, sf):
    train = _wide(spark, sf, False)
    test = _wide(spark, sf, True).withColumn("p", _mean_col())
    pseudo = PS.two_sided(test, 0.85)
    out = PS.augment(train, pseudo)
    return out.select("id", "label", "weight", "is_pseudo")


register("pseudo_two_sided", _sql(
    _wide_sql(False).replace("wide AS", "trw AS").replace("WHERE NOT is_test", "WHERE NOT is_test"),
    _wide_sql(True),
) + f"SELECT id, label, CAST(1.0 AS DOUBLE) AS weight, false AS is_pseudo FROM trw UNION ALL "
    f"SELECT id, CAST({MEAN_SQL} >= 0.5 AS INTEGER), greatest({MEAN_SQL}, 1.0 - {MEAN_SQL}), true FROM wide "
    f"WHERE {MEAN_SQL} >= 0.85 OR {MEAN_SQL} <= 1 - 0.85")(pseudo_two_sided)


# ------------------------------------------------------------------ AGG-17
def prediction_summary(spark, sf):
    from sparkfeat.operators.profile import prediction_summary as ps
    test = _wide(spark, sf, True).select((_mean_col() > 0.5).cast("int").alias("pred"),
                                         confidence(_mean_col()).alias("conf"))
    out = ps(test, "pred", "conf")
    return out.select("pred", "n", F.round("share", 6).alias("share"), F.round("mean_conf", 6).alias("mean_conf"))


register("prediction_summary", _sql(_wide_sql(True)) +
         f"SELECT pred, count(*) AS n, {r6('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share, "
         f"{r6('avg(conf)')} AS mean_conf FROM (SELECT CAST({MEAN_SQL} > 0.5 AS INTEGER) AS pred, "
         f"greatest({MEAN_SQL}, 1.0 - {MEAN_SQL}) AS conf FROM wide) GROUP BY pred")(prediction_summary)


# ------------------------------------------------------------------ SNK-4
def prediction_file(spark, sf):
    """The prediction file, written and read back."""
    pred = sinks.prediction_frame(_wide(spark, sf, True).withColumn("p", _mean_col()), "id", "p", "F", "other", "status")
    path = f"{checkpoint_dir(spark).rstrip('/')}/sparkfeat-predictions/{uuid.uuid4().hex}"
    sinks.write_predictions(pred, path)
    return spark.read.schema(pred.schema).option("header", True).csv(path)


register("prediction_file", _sql(_wide_sql(True)) +
         f"SELECT id, CASE WHEN {MEAN_SQL} > 0.5 THEN 'F' ELSE 'other' END AS status FROM wide")(prediction_file)


# ------------------------------------------------------------------ EVL-6 (AUC by rank sum)
def auc_models(spark, sf):
    """Per-model AUC of the out-of-fold scores, by the distributed rank sum."""
    from sparkfeat.operators.models import auc_rank_sum
    s = scored(spark, sf).filter(~F.col("is_test"))
    return auc_rank_sum(s, "label", "p", by="model").select("model", F.round("auc", 6).alias("auc"))


register("auc_models", _sql(
    "c AS (SELECT model, p, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM scored "
    "WHERE NOT is_test GROUP BY model, p)",
    "r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS below FROM c)",
) + f"SELECT model, {r6('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM r GROUP BY model")(auc_models)
