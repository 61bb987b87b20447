"""Model-based queries on the document profile (MOD-*, ENS-2..5, EVL-5/6,
CLU-*, PSL-2, AGG-16). Model outputs have no SQL oracle: rows-only checks,
plus invariants in the tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.functions.hashing import sql_hash32, sql_uniform
from sparkfeat.operators import ensemble as EN
from sparkfeat.operators import models as MD
from sparkfeat.operators import pseudo as PS
from sparkfeat.operators import stacking as ST
from sparkfeat.operators.encode import apply_codes, apply_standard, fit_codes, fit_standard
from sparkfeat.operators.folds import hash_fold, stratified_fold
from sparkfeat.operators.text import family_of, feature_families
from sparkfeat.plans.q_text import family_table
from sparkfeat.session import cut_lineage, fitted_rows
from sparkfeat.sources.fixtures import DOC_FEATURES, ORDER_SPEC, doc_profile, scored, scored_sql
from sparkfeat.sources.tables import read_table

K = 5
# Boosting rounds, trees and steps of the registered queries.
ROUNDS, TREES, STEPS = 20, 100, 1000
FEATS = list(DOC_FEATURES)


def _train_test(spark, sf):
    d = doc_profile(spark, sf)
    train = d.filter(~F.col("is_test")).withColumn("label", F.col("quality").cast("int"))
    test = d.filter(F.col("is_test"))
    return train, test


def _vectors(train, test=None):
    """Feature vectors scaled by the training rows: penalties and step sizes mean the same for every column."""
    scale = fit_standard(train, FEATS)
    train, test = (None if d is None else MD.assemble(apply_standard(d, scale, "z"), [f"{c}_z" for c in FEATS]) for d in (train, test))
    return [fitted_rows(train, len(FEATS)), test]


def _base_estimators():
    return {"gbt": MD.make_model("gbt", max_iter=ROUNDS, depth=3),
            "rf": MD.make_model("rf", trees=TREES, depth=5, min_leaf=4),
            "lr": MD.make_model("lr", C=1.0, max_iter=STEPS)}


def _oof(spark, sf, with_test=False):
    train, test = _train_test(spark, sf)
    train, te = _vectors(cut_lineage(stratified_fold(train, "doc_id", "label", K, 42)), cut_lineage(test) if with_test else None)
    oof, tst = MD.oof_predictions(train, te, _base_estimators(), "doc_id", "label", "fold", K)
    return oof, tst


# ------------------------------------------------------------------ ENS-3 / MOD-1,3,4
@register("model_oof")
def model_oof(spark, sf):
    oof, _ = _oof(spark, sf)
    return oof


# ------------------------------------------------------------------ EVL-1/2 on real models
@register("cv_models")
def cv_models(spark, sf):
    oof, _ = _oof(spark, sf)
    summary = cut_lineage(EN.cv_summary(oof))      # used twice: predict once
    return summary.join(EN.leaderboard(summary).select("model", "rank"), "model")


# ------------------------------------------------------------------ ENS-4
@register("blend_lr")
def blend_lr(spark, sf):
    oof, tst = _oof(spark, sf, with_test=True)
    coefs, blended = MD.blend(oof, tst, ["gbt", "rf", "lr"], "doc_id", C=0.01)
    return blended.select("doc_id", "p")


@register("blend_coefficients")
def blend_coefficients(spark, sf):
    oof, _ = _oof(spark, sf)
    coefs, _ = MD.blend(oof, None, ["gbt", "rf", "lr"], "doc_id", C=0.01)
    return coefs


# ------------------------------------------------------------------ ENS-5
@register("stack_meta")
def stack_meta(spark, sf):
    """Two meta models scored by an inner 3-fold CV on the OOF columns; the better one wins."""
    oof, _ = _oof(spark, sf)
    bases = ["gbt", "rf", "lr"]
    wide = cut_lineage(hash_fold(EN.pivot_scores(oof, bases, "doc_id"), "doc_id", 3, 11, "inner"))
    wide = MD.assemble(wide, [f"p_{m}" for m in bases])
    metas = {"meta_lr": MD.make_model("lr", C=0.01), "meta_rf": MD.make_model("rf", trees=TREES, depth=3)}
    inner, _ = MD.oof_predictions(wide, None, metas, "doc_id", "label", "inner", 3)
    cv = cut_lineage(EN.cv_summary(inner))
    best = cv.agg(F.max_by("model", F.struct("mean_acc", "model")).alias("best")).first()["best"]  # 2 rows
    return cv.withColumn("chosen", F.col("model") == F.lit(best))


# ------------------------------------------------------------------ ENS-2 + PSL-3
@register("weighted_vote")
def weighted_vote(spark, sf):
    train, test = (cut_lineage(d) for d in _train_test(spark, sf))     # the text features once
    lr = MD.make_model("lr", C=1.0).fit(MD.assemble(train, FEATS))
    scored = lr.transform(MD.assemble(test, FEATS)).select("doc_id", MD.p_one().alias("p"))
    pseudo = PS.two_sided(scored.withColumnRenamed("doc_id", "id"), 0.85).withColumnRenamed("id", "doc_id")
    aug = train.select("doc_id", "label", *FEATS).withColumns({"weight": F.lit(1.0)}).unionByName(
        pseudo.join(test.select("doc_id", *FEATS), "doc_id").select("doc_id", "label", *FEATS, "weight"))
    return MD.weighted_vote(cut_lineage(aug), test, ["gbt", "lr", "mlp"], FEATS, "doc_id", "label", "weight",
                            {"gbt": {"max_iter": ROUNDS}, "mlp": {"layers": [len(FEATS), 16, 2]}})


# ------------------------------------------------------------------ EVL-6
@register("adversarial_auc")
def adversarial_auc(spark, sf):
    train, test = _train_test(spark, sf)
    oof = cut_lineage(MD.adversarial(cut_lineage(train), cut_lineage(test), FEATS, "doc_id", K, ROUNDS))
    rank_auc = MD.auc_rank_sum(oof).select(F.lit("auc_rank_sum").alias("metric"), F.col("auc").alias("value"))
    builtin = spark.createDataFrame([("auc_evaluator", MD.auc_builtin(oof))], "metric string, value double")
    return rank_auc.unionByName(builtin)


# ------------------------------------------------------------------ EVL-5 / AGG-16 / SRT-1
def _importance(spark, sf):
    train, _ = _train_test(spark, sf)
    rows = fitted_rows(MD.assemble(train, FEATS).select("features", "label"), len(FEATS))
    model = MD.make_model("rf", trees=TREES, depth=5, min_leaf=4).fit(rows)
    imp = MD.importances(model, FEATS, spark)
    return imp.withColumn("family", family_of("feature", FEATS))


@register("feature_importance")
def feature_importance(spark, sf):
    imp = _importance(spark, sf)
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return imp.withColumn("rank", F.row_number().over(w))


@register("importance_by_family")
def importance_by_family(spark, sf):
    """Importances over a table with all families; text columns enter as their codes."""
    rows = cut_lineage(family_table(spark, sf))
    cols = [c for c in rows.columns if c not in ("id", "label")]
    strings = [c for c in cols if dict(rows.dtypes)[c] == "string"]
    codes = fit_codes(rows, strings)
    coded = apply_codes(rows, codes, strings, "id").withColumns({c: F.col(f"{c}_code") for c in strings})
    vectors = fitted_rows(MD.assemble(coded.fillna(0.0, subset=cols), cols).select("features", "label"), len(cols))
    model = MD.make_model("rf", trees=TREES, depth=5, min_leaf=4).fit(vectors)
    imp = MD.importances(model, cols, spark).join(feature_families(rows, cols, ORDER_SPEC.numeric), "feature")
    return imp.groupBy("family").agg(F.avg("importance").alias("mean"), F.sum("importance").alias("total"),
                                     F.avg((F.col("importance") < 0.001).cast("double")).alias("low_share"))


# ------------------------------------------------------------------ CLU-1/2
@register("kmeans_clusters")
def kmeans_clusters(spark, sf):
    d = cut_lineage(doc_profile(spark, sf))
    out = MD.kmeans_features(d, FEATS, 5, 42, fit_on=d.filter(~F.col("is_test")))
    return out.select("doc_id", "cluster", *[f"cluster_{i}_distance" for i in range(5)])


# ------------------------------------------------------------------ CLU-3
@register("pca_components")
def pca_components(spark, sf):
    d = cut_lineage(doc_profile(spark, sf))
    out, _ = MD.pca_features(d, FEATS, 3, fit_on=d.filter(~F.col("is_test")))
    return out.select("doc_id", "pca_0", "pca_1", "pca_2")


# ------------------------------------------------------------------ PSL-2
@register("pseudo_iterative")
def pseudo_iterative(spark, sf):
    train, test = (cut_lineage(d) for d in _train_test(spark, sf))
    feats = train.select("doc_id", *FEATS).unionByName(test.select("doc_id", *FEATS))

    feats = feats.withColumnRenamed("doc_id", "id")

    def score(current, pool):
        cur = current.join(feats, "id")
        model = MD.make_model("lr", C=1.0, weight="weight").fit(MD.assemble(cur, FEATS))
        sc = model.transform(MD.assemble(pool.join(feats, "id"), FEATS))
        return sc.select("id", MD.p_one().alias("p"))

    out = PS.iterative(train.select(F.col("doc_id").alias("id"), "label"),
                       test.select(F.col("doc_id").alias("id")), score,
                       rounds=2, threshold=0.9, ratio=0.1, weight=0.7, id_col="id")
    return out


# ------------------------------------------------------------------ MOD-2/5/6/7
@register("model_zoo")
def model_zoo(spark, sf):
    train, _ = _train_test(spark, sf)
    train = fitted_rows(stratified_fold(train, "doc_id", "label", K, 42), len(FEATS))
    assembled = MD.assemble(train, FEATS)
    ests = {
        "hgb": MD.make_model("hgb", max_iter=ROUNDS, depth=4, min_leaf=8),
        "mlp": MD.make_model("mlp", layers=[len(FEATS), 16, 2], max_iter=STEPS),
        "lr_l1": MD.make_model("lr", C=0.1, l1=1.0, max_iter=STEPS),
    }
    oof, _ = MD.oof_predictions(assembled, None, ests, "doc_id", "label", "fold", K)
    pipe = MD.encoded_model(["lang", "source"], FEATS, "gbt", max_iter=ROUNDS, depth=3)
    oof2, _ = MD.oof_predictions(train, None, {"enc_gbt": pipe}, "doc_id", "label", "fold", K)
    return EN.cv_summary(oof.unionByName(oof2))


@register("early_stopping")
def early_stopping(spark, sf):
    train, _ = _train_test(spark, sf)
    tr = MD.assemble(cut_lineage(hash_fold(train, "doc_id", 5, 3, "vf")), FEATS).withColumn("is_val", F.col("vf") == 0)
    model = MD.make_model("gbt", max_iter=40, depth=4, step=0.1, subsample=0.8,
                          validation_col="is_val").fit(tr)
    val = model.transform(tr.filter("is_val"))
    acc = val.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("val_acc"))
    return acc.withColumn("trees", F.lit(model.getNumTrees))


# ------------------------------------------------------------------ AGG-18 (model rule)
@register("noise_features")
def noise_features(spark, sf):
    """Share of features with importance < 0.001; an issue above 30%."""
    imp = _importance(spark, sf)
    share = imp.agg(F.avg((F.col("importance") < 0.001).cast("double")).alias("value"))
    from sparkfeat.operators.profile import flag_rules
    return flag_rules(share.select(F.lit("low_importance_share").alias("metric"), "value"),
                      {"low_importance_share": (">", 0.3)})


# ------------------------------------------------------------------ ENS-5 fitted, EVL-2 with failures
def _stack_bases():
    return {"boost_b": MD.make_model("boost_b", max_iter=ROUNDS, depth=3), "hgb": MD.make_model("hgb", max_iter=ROUNDS, depth=4, min_leaf=8),
            "rf": MD.make_model("rf", trees=TREES, depth=5, min_leaf=4), "lr": MD.make_model("lr", C=1.0, max_iter=STEPS),
            "lr_l1": MD.make_model("lr", C=0.1, l1=1.0, max_iter=STEPS)}


_FOLD_SQL = f"CASE WHEN l.quality IS NOT NULL THEN CAST({sql_hash32('d.doc_id')} % {K} AS INTEGER) END"


def stack_model(spark, sf):
    """A stack of five bases fitted on the labelled documents and applied to the others.

    A labelled row: its fold (others: -1), under how many outer folds it has base probabilities, and how
    often one of them came from bases that saw the row's or the outer fold. Any row: whether
    its probabilities are all there and in [0, 1].
    """
    train, test = _train_test(spark, sf)
    train, test = cut_lineage(hash_fold(train, "doc_id", K)), cut_lineage(test)
    train, test = _vectors(train, test)
    bases = _stack_bases()
    metas = {"lr": MD.make_model("lr", C=1.0, max_iter=STEPS),
             "mlp": MD.make_model("mlp", layers=[len(bases), 20, 2], max_iter=500)}
    model = ST.Stacking(bases, metas, "doc_id", "label", "fold", K).fit(train)
    fine = F.expr(" AND ".join(f"coalesce(p_{b} BETWEEN 0 AND 1, false)" for b in bases))
    leak = F.array_contains("seen", F.col("fold")) | F.array_contains("seen", F.col("held"))
    seen = model.views.groupBy("doc_id", "fold").agg(
        F.count("*").alias("views"), F.count_if(leak).alias("leaks"), F.every(fine).alias("scored"))
    applied = model.transform(test).select(
        "doc_id", F.lit(-1).alias("fold"), F.lit(0).cast("bigint").alias("views"), F.lit(0).cast("bigint").alias("leaks"),
        (fine & F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("scored"))
    return seen.unionByName(applied)


register("stack_model",
         f"SELECT d.doc_id, coalesce({_FOLD_SQL}, -1) AS fold, CASE WHEN l.quality IS NOT NULL THEN {K} ELSE 0 END::BIGINT AS views, "
         "0::BIGINT AS leaks, true AS scored FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(stack_model)


def leaderboard_failures(spark, sf):
    """Cross-fitted models, one of which cannot be fitted: it scores 0 and is last."""
    train, _ = _train_test(spark, sf)
    train, _ = _vectors(cut_lineage(hash_fold(train, "doc_id", K)))
    models = {"lr": MD.make_model("lr", C=1.0, max_iter=STEPS), "rf": MD.make_model("rf", trees=TREES, depth=5, min_leaf=4),
              "broken": MD.make_model("mlp", layers=[len(FEATS) + 1, 4, 2], max_iter=5)}     # expects a column more
    failures: dict = {}
    oof, _ = MD.oof_predictions(train, None, models, "doc_id", "label", "fold", K, failures)
    board = EN.leaderboard(EN.cv_summary(oof), sorted(failures))
    return board.select("model", F.when(F.col("mean_acc") > 0, "scored").otherwise("failed").alias("status"),
                        (F.col("rank") == len(models)).alias("is_last"), F.col("mean_acc").between(0, 1).alias("in_range"))


register("leaderboard_failures",
         "SELECT m.model, CASE WHEN m.model = 'broken' THEN 'failed' ELSE 'scored' END AS status, m.model = 'broken' AS is_last, "
         "count(*) > 0 AS in_range FROM labels, (SELECT unnest(['lr', 'rf', 'broken']) AS model) m "
         "WHERE quality IS NOT NULL GROUP BY m.model")(leaderboard_failures)


def oof_contract(spark, sf):
    """Cross-fitted probabilities of four model families: every labelled row once per model, by
    the model that did not see its fold."""
    train, _ = _train_test(spark, sf)
    train, _ = _vectors(cut_lineage(hash_fold(train, "doc_id", K)))
    models = {"boost_a": MD.make_model("boost_a", max_iter=ROUNDS, depth=3), "boost_b": MD.make_model("boost_b", max_iter=ROUNDS, depth=3),
              "boost_c": MD.make_model("boost_c", max_iter=ROUNDS), "lr": MD.make_model("lr", C=1.0, max_iter=STEPS)}
    oof, _ = MD.oof_predictions(train, None, models, "doc_id", "label", "fold", K)
    return oof.select("doc_id", "model", "fold", "label", F.col("p").between(0, 1).alias("in_range"))


register("oof_contract",
         f"SELECT d.doc_id, m.model, {_FOLD_SQL} AS fold, CAST(l.quality AS INTEGER) AS label, true AS in_range "
         "FROM documents d JOIN labels l ON l.doc_id = d.doc_id, (SELECT unnest(['boost_a', 'boost_b', 'boost_c', 'lr']) AS model) m "
         "WHERE l.quality IS NOT NULL")(oof_contract)


# ------------------------------------------------------------------ MOD-6 replicas, EVL-6 folds
def weighted_replicas(spark, sf):
    """Orders replicated by total price / 40,000: copies per order."""
    o = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 40000.0).alias("w"))
    return MD.replicate_by_weight(o, "w", "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("copies"))


_W = "o_totalprice / 40000.0"
register("weighted_replicas",
         f"SELECT o_orderkey, copies FROM (SELECT o_orderkey, CAST(floor({_W}) + CASE WHEN {sql_uniform('o_orderkey', 42, 'replicas')} "
         f"< {_W} - floor({_W}) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM orders) WHERE copies > 0")(weighted_replicas)


def adversarial_folds(spark, sf):
    """Folds by quantile of a score, over the whole score table of one model."""
    given = scored(spark, sf).filter("model = 'm1'")
    return MD.adversarial_folds(given, "id", K)


register("adversarial_folds", "WITH " + scored_sql() + f""" SELECT id, p,
 CAST(floor((row_number() OVER (ORDER BY p, id) - 1) * {K} / count(*) OVER ()) AS INTEGER) AS fold FROM scored WHERE model = 'm1'""")(adversarial_folds)
