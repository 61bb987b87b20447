"""End-to-end flows for the reference's three entry points.

Each flow reads its input once, cuts lineage where several reports or fits
reuse it (a reliable checkpoint in the shared folder — a lost executor
re-reads it instead of recomputing the joins), and writes its outputs with
the sinks. The building blocks are the registered operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.operators import ensemble as EN
from sparkfeat.operators import features as X
from sparkfeat.operators import models as MD
from sparkfeat.operators import profile as P
from sparkfeat.operators import pseudo as PS
from sparkfeat.operators import text as T
from sparkfeat.operators.folds import stratified_fold
from sparkfeat.session import checkpoint_dir, cut_lineage
from sparkfeat.sources import sinks
from sparkfeat.sources.fixtures import DOC_FEATURES, ORDER_SPEC, doc_profile, order_profile

RULES = {"high_corr_pairs": (">", 10), "low_info_share": (">", 0.3), "max_missing_share": (">", 0.3)}


def profile_and_diagnose(spark: SparkSession, sf: str, out: str | None = None) -> DataFrame:
    """Entry C: quality, low-information columns, correlation, rule flags."""
    df = cut_lineage(order_profile(spark, sf))  # read once, five reports use it
    nums = list(ORDER_SPEC.numeric)
    corr = P.corr_long(df, nums)
    low = T.low_info_report(df, list(ORDER_SPEC.categorical), nums)
    metrics = reduce(DataFrame.unionByName, [
        corr.agg(F.count_if("high").cast("double").alias("value")).select(
            F.lit("high_corr_pairs").alias("metric"), "value"),
        low.agg(F.avg((~F.col("kept")).cast("double")).alias("value")).select(
            F.lit("low_info_share").alias("metric"), "value"),
        df.agg(F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in nums]).alias("value")).select(
            F.lit("max_missing_share").alias("metric"), "value"),
    ])
    report = P.flag_rules(metrics, RULES)
    sinks.write_metrics(report, out or f"{checkpoint_dir(spark).rstrip('/')}/sparkfeat-reports/diagnosis")
    return report


def hybrid(spark: SparkSession, sf: str, threshold: float = 0.85, rounds: int = 100) -> dict:
    """Entry A: features → 3-model vote → two-sided pseudo-labels →
    evaluation on original rows only (T12) → weighted final vote."""
    d = doc_profile(spark, sf)
    feats = list(DOC_FEATURES)
    fs = X.FeatureSet().add(feature_mean=X.row_mean(feats), feature_std=X.row_std(feats),
                            feature_max=X.row_max(feats), feature_min=X.row_min(feats))
    d = cut_lineage(fs.transform(d))
    cols = feats + fs.names
    train = d.filter(~F.col("is_test")).withColumn("label", F.col("quality").cast("int"))
    test = d.filter(F.col("is_test"))
    tr_vec = MD.assemble(train, cols)
    te_vec = MD.assemble(test, cols)
    kinds = {"gbt": MD.make_model("gbt", max_iter=rounds, depth=3), "rf": MD.make_model("rf"),
             "lr": MD.make_model("lr", C=1.0)}
    parts = [m.fit(tr_vec).transform(te_vec).select("doc_id", MD.p_one().alias("p")) for m in kinds.values()]
    vote = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.avg("p").alias("p"))
    pseudo = PS.two_sided(vote.withColumnRenamed("doc_id", "id"), threshold).withColumnRenamed("id", "doc_id")
    aug = train.select("doc_id", "label", *cols, F.lit(1.0).alias("weight"), F.lit(False).alias("is_pseudo")) \
        .unionByName(pseudo.join(test.select("doc_id", *cols), "doc_id").select(
            "doc_id", "label", *cols, "weight", "is_pseudo"))
    aug = cut_lineage(stratified_fold(aug, "doc_id", "label", 5, 42))
    oof, _ = MD.oof_predictions(MD.assemble(aug, cols), None,
                                {"lr": MD.make_model("lr", C=1.0, weight="weight")},
                                "doc_id", "label", "fold", 5)
    original_only = oof.join(aug.filter(~F.col("is_pseudo")).select("doc_id"), "doc_id", "left_semi")
    final = MD.weighted_vote(aug, test, ["gbt", "lr"], cols, "doc_id", "label", "weight", {"gbt": {"max_iter": rounds}})
    return {"cv_original_rows": EN.cv_summary(original_only), "cv_all_rows": EN.cv_summary(oof),
            "predictions": sinks.prediction_frame(final, "doc_id", "p", "good", "poor", "quality")}


def baseline_blend(spark: SparkSession, sf: str, rounds: int = 100) -> dict:
    """Entry B: encoder + model refitted per fold (MOD-7), OOF probabilities
    of three models (ENS-3), logistic blend with C=0.01 (ENS-4)."""
    d = doc_profile(spark, sf)
    feats = list(DOC_FEATURES)
    train = cut_lineage(stratified_fold(d.filter(~F.col("is_test")).withColumn(
        "label", F.col("quality").cast("int")), "doc_id", "label", 5, 42))
    test = d.filter(F.col("is_test"))
    ests = {k: MD.encoded_model(["lang", "source"], feats, k, **({"max_iter": rounds} if k == "gbt" else {}))
            for k in ("gbt", "rf", "lr")}
    oof, tst = MD.oof_predictions(train, test, ests, "doc_id", "label", "fold", 5)
    coefs, blended = MD.blend(oof, tst, list(ests), "doc_id", C=0.01)
    return {"oof_cv": EN.cv_summary(oof), "coefficients": coefs,
            "predictions": sinks.prediction_frame(blended, "doc_id", "p", "good", "poor", "quality",
                                                  inclusive=True)}
