"""Ensembles and evaluation over prediction tables (ENS-1, 6..8, EVL-1..4).

Predictions are a long table (id, model, p[, label, fold]). Voting is a
``groupBy(id)``; weight search evaluates every candidate weighting as an
expression over the pivoted scores — the candidate table is a driver-side
parameter list (trials × models numbers), so nothing is joined or
replicated per row and all trials are scored in ONE aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import py_hash32


def soft_vote(pred: DataFrame, id_col: str = "id", p_col: str = "p",
              keep=("label",)) -> DataFrame:
    """ENS-1: mean probability per row."""
    return pred.groupBy(id_col, *keep).agg(F.avg(p_col).alias("p_mean"))


def pivot_scores(pred: DataFrame, models, id_col: str = "id", keep=("label",)) -> DataFrame:
    """Wide (id, keep..., p_<model>) on a fixed model list: one conditional
    aggregation, one shuffle by id (``pivot`` would add a second one)."""
    return pred.groupBy(id_col, *keep).agg(
        *[F.max(F.when(F.col("model") == m, F.col("p"))).alias(f"p_{m}") for m in models])


def candidate_weights(n_trials: int, models, seed: int = 42, salt: str = "w") -> list[list[float]]:
    """Hash-seeded candidate weightings, each normalised to sum 1."""
    out = []
    for t in range(n_trials):
        raw = [float(py_hash32(seed, salt, t, m)) for m in models]
        tot = raw[0]
        for r in raw[1:]:
            tot = tot + r
        out.append([r / tot for r in raw])
    return out


def weighted_score(weights, models) -> Column:
    expr = F.lit(weights[0]) * F.col(f"p_{models[0]}")
    for w, m in zip(weights[1:], models[1:]):
        expr = expr + F.lit(w) * F.col(f"p_{m}")
    return expr


def correct(score: Column, label: str = "label", threshold: float = 0.5) -> Column:
    return ((score > threshold).cast("int") == F.col(label)).cast("double")


def weight_search(wide: DataFrame, models, n_trials: int = 100, seed: int = 42,
                  by: str | None = None, salt: str = "w") -> DataFrame:
    """ENS-6/7: accuracy of every candidate weighting (per group ``by``).

    Returns (by?, trial, w_<model>..., acc, n).
    """
    cands = candidate_weights(n_trials, models, seed, salt)
    keys = [by] if by else []
    aggs = [F.count("*").alias("n")] + [
        F.avg(correct(weighted_score(w, models))).alias(f"acc_{t}") for t, w in enumerate(cands)]
    row = wide.groupBy(*keys).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(t).alias("trial"), *[F.lit(w[i]).alias(f"w_{m}") for i, m in enumerate(models)],
                             F.col(f"acc_{t}").alias("acc")) for t, w in enumerate(cands)])
    return row.select(*keys, "n", F.explode(arr).alias("c")).select(*keys, "n", "c.*")


def best_trial(search: DataFrame, by: str | None = None) -> DataFrame:
    """Arg-max accuracy, ties → lowest trial (SRT-2 over a small table)."""
    keys = [by] if by else []
    best = search.groupBy(*keys).agg(
        F.max(F.struct(F.col("acc"), (-F.col("trial")).alias("neg_trial"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg_trial")).alias("trial"), F.col("b.acc").alias("acc"))


def range_of(p: Column, low: float = 0.3, high: float = 0.7) -> Column:
    """ENS-8 ranges, half-open as when applying (T17): ≤low, ≤high, else."""
    return F.when(p <= low, "low").when(p <= high, "mid").otherwise("high")


# ------------------------------------------------------------------ EVL
def fold_accuracy(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """EVL-1: (model, fold, n, acc) from a long prediction table."""
    return pred.groupBy("model", "fold").agg(
        F.count("*").alias("n"), F.avg(correct(F.col("p"), "label", threshold)).alias("acc"))


def cv_summary(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """EVL-1: per model mean and population std of fold accuracies, pooled
    out-of-fold accuracy and the ±2·std band."""
    folds = fold_accuracy(pred, threshold)
    per_model = folds.groupBy("model").agg(
        F.avg("acc").alias("mean_acc"), F.stddev_pop("acc").alias("std_acc"),
        (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("pooled_acc"))
    return per_model.withColumns({"ci_lo": F.col("mean_acc") - 2 * F.col("std_acc"),
                                  "ci_hi": F.col("mean_acc") + 2 * F.col("std_acc")})


def leaderboard(summary: DataFrame, failed=()) -> DataFrame:
    """EVL-2: models sorted by mean accuracy (rank over ≤ models rows); the names in
    ``failed``, models that could not be fitted, have 0 and rank last."""
    rows = summary.select("model", "mean_acc", F.lit(False).alias("__failed"))
    if failed:
        lost = summary.sparkSession.createDataFrame([(m,) for m in failed], "model string")
        rows = rows.unionByName(lost.select("model", F.lit(0.0).alias("mean_acc"), F.lit(True).alias("__failed")))
    w = Window.orderBy("__failed", F.desc("mean_acc"), F.asc("model"))
    return rows.withColumn("rank", F.row_number().over(w)).select("model", "mean_acc", "rank")


def status_band(delta: Column) -> Column:
    """EVL-3 status bands."""
    return (F.when(delta >= 0.005, "significant").when(delta >= 0.003, "moderate")
            .when(delta > 0, "slight").otherwise("none"))


def confusion(pred: DataFrame, label: str = "label", pred_col: str = "pred") -> DataFrame:
    """EVL-4: per class precision / recall / F1 / support + macro and weighted rows."""
    cm = pred.groupBy(label, pred_col).agg(F.count("*").alias("n"))
    classes = pred.groupBy(label).agg(F.count("*").alias("support")).withColumnRenamed(label, "cls")
    tp = cm.filter(F.col(label) == F.col(pred_col)).select(F.col(label).alias("cls"), F.col("n").alias("tp"))
    pp = cm.groupBy(pred_col).agg(F.sum("n").alias("pred_n")).withColumnRenamed(pred_col, "cls")
    per = (classes.join(tp, "cls", "left").join(pp, "cls", "left").fillna(0, subset=["tp", "pred_n"]))
    per = per.select(
        F.col("cls").cast("string").alias("cls"), "support",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pred_n").cast("double")), F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.col("support")).alias("recall"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = F.sum("support").over(Window.partitionBy())
    macro = per.agg(F.lit("macro").alias("cls"), F.sum("support").alias("support"),
                    F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    weighted = per.withColumn("w", F.col("support") / tot).agg(
        F.lit("weighted").alias("cls"), F.sum("support").alias("support"),
        F.sum(F.col("w") * F.col("precision")).alias("precision"),
        F.sum(F.col("w") * F.col("recall")).alias("recall"), F.sum(F.col("w") * F.col("f1")).alias("f1"))
    return per.unionByName(macro).unionByName(weighted)


def confusion_counts(pred: DataFrame, label: str = "label", pred_col: str = "pred") -> DataFrame:
    return pred.groupBy(label, pred_col).agg(F.count("*").alias("n"))

