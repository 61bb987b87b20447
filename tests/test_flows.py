"""End-to-end flows on the smallest tables."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL


def test_hybrid_flow(spark):
    from sparkfeat.plans.flows import hybrid
    out = hybrid(spark, SF_SMALL, rounds=10)
    orig = out["cv_original_rows"].toPandas()
    assert len(orig) == 1 and 0.0 <= orig.mean_acc.item() <= 1.0
    pred = out["predictions"]
    assert pred.filter(~F.col("quality").isin("good", "poor")).count() == 0
    assert pred.count() == pred.select("doc_id").distinct().count()


def test_baseline_blend_flow(spark):
    from sparkfeat.plans.flows import baseline_blend
    out = baseline_blend(spark, SF_SMALL, rounds=5)
    terms = set(out["coefficients"].toPandas().term)
    assert terms == {"gbt", "rf", "lr", "intercept"}
    assert out["oof_cv"].count() == 3
