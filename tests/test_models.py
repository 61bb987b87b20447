"""Stacking, fault-tolerant cross-fitting, weighted replicas, folds by score."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfeat.operators import ensemble as EN
from sparkfeat.operators import models as MD
from sparkfeat.operators.folds import hash_fold
from sparkfeat.operators.stacking import Stacking, base_views


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=240) > 0).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "doc_id long, a double, b double, label int").coalesce(2)
    return MD.assemble(hash_fold(df, "doc_id", 3).cache(), ["a", "b"])


def estimators():
    return {"rf": MD.make_model("rf", trees=10, depth=4, min_leaf=4), "lr": MD.make_model("lr")}


def broken():
    return {"broken": MD.make_model("mlp", layers=[7, 2, 2], max_iter=3)}      # the vectors have two columns


def test_stack_is_nested_and_can_be_applied(spark, toy):
    metas = {"lr": MD.make_model("lr"), "mlp": MD.make_model("mlp", layers=[2, 4, 2], max_iter=30)}
    model = Stacking(estimators() | broken(), metas, "doc_id", k=3).fit(toy)
    assert set(model.failures) == {"broken"} and set(model.models) == {"rf", "lr"}
    views = model.views.collect()
    assert len(views) == 3 * 240                                    # each row once per outer fold
    for r in views:
        assert r.fold not in r.seen and r.held not in r.seen and sorted({*r.seen, r.fold, r.held}) == [0, 1, 2]
        assert 0 <= r.p_rf <= 1 and 0 <= r.p_lr <= 1
    means = {m: np.mean([a for n, _, _, a in model.scores if n == m]) for m in metas}
    assert len(model.scores) == 6 and means[model.winner] == max(means.values()) and means[model.winner] > 0.7
    new = spark.createDataFrame([(1, 2.0, 2.0, "x"), (2, -2.0, 2.0, "y")], "doc_id long, a double, b double, extra string")
    got = {r.doc_id: r for r in model.transform(MD.assemble(new, ["a", "b"])).collect()}
    assert got[1].p > 0.5 > got[2].p and got[1].extra == "x"


def test_views_repeat_what_the_folds_say(toy):
    """The single-fold view of a base equals a plain cross-fit of it."""
    views, failed = base_views(toy, {"lr": MD.make_model("lr")}, "doc_id", "label", "fold", 3)
    oof, _ = MD.oof_predictions(toy, None, {"lr": MD.make_model("lr")}, "doc_id", "label", "fold", 3)
    one = views.filter("held = fold").join(oof, "doc_id")
    assert not failed and one.count() == 240 and one.agg(F.max(F.abs(F.col("p") - F.col("p_lr")))).first()[0] < 1e-9


def test_a_failing_model_scores_zero_and_is_last(toy):
    failures = {}
    oof, test = MD.oof_predictions(toy, toy.select("doc_id", "features"), estimators() | broken(), "doc_id", "label", "fold", 3, failures)
    assert set(failures) == {"broken"} and oof.count() == 2 * 240 and test.count() == 2 * 240
    board = EN.leaderboard(EN.cv_summary(oof), failures).orderBy("rank").collect()
    assert [(r.model, r["rank"]) for r in board][-1] == ("broken", 3) and board[-1].mean_acc == 0.0
    with pytest.raises(Exception):
        MD.oof_predictions(toy, None, broken(), "doc_id", "label", "fold", 3)
    with pytest.raises(RuntimeError):
        MD.oof_predictions(toy, None, broken(), "doc_id", "label", "fold", 3, {})


def test_replicas_follow_the_weights(spark):
    rows = [(i, w) for i, w in enumerate([0.0, -1.0, None, 1.0, 2.0, 2.5, 0.25] * 400)]
    df = spark.createDataFrame(rows, "id long, w double").repartition(5)
    counts = {r.id: r["count"] for r in MD.replicate_by_weight(df, "w", "id").groupBy("id").count().collect()}
    for w, low, high in ((0.0, 0, 0), (-1.0, 0, 0), (None, 0, 0), (1.0, 1, 1), (2.0, 2, 2), (2.5, 2, 3), (0.25, 0, 1)):
        own = [counts.get(i, 0) for i, x in rows if x == w]
        assert min(own) == low and max(own) == high and abs(sum(own) - len(own) * max(w or 0, 0)) < 40
    assert counts == {r.id: r["count"] for r in MD.replicate_by_weight(df.repartition(2), "w", "id").groupBy("id").count().collect()}


def test_a_network_hears_its_weights(spark):
    """Two rows that contradict each other at each place: the heavier one wins."""
    rows = [(2 * i + y, float(i % 2), y, 5.0 if y == i % 2 else 0.2) for i in range(60) for y in (0, 1)]
    df = MD.assemble(spark.createDataFrame(rows, "id long, x double, label int, w double").coalesce(1), ["x"])
    model = MD.make_model("mlp", layers=[1, 4, 2], max_iter=60, weight="w").fit(df)
    got = {r.x: r.p for r in model.transform(df).select("x", MD.p_one().alias("p")).distinct().collect()}
    assert got[0.0] < 0.2 and got[1.0] > 0.8


def test_folds_by_score(spark):
    rows = [(i, None if i % 13 == 0 else (i * 7 % 10) / 10) for i in range(103)]
    got = MD.adversarial_folds(spark.createDataFrame(rows, "id long, p double").repartition(4), "id", 5).collect()
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert {r.id: r.fold for r in got} == {i: n * 5 // 103 for n, (i, _) in enumerate(order)}


def test_rows_to_fit_on_lie_in_partitions_by_their_own_size(spark, monkeypatch):
    """Few numbers from many partitions: one task a pass; more of them: more tasks. Order stays."""
    from sparkfeat import session
    from sparkfeat.plans import q_models as QM
    rows = spark.range(0, 1200, 1, 12).select("id", *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(QM.FEATS)])
    train, test = QM._vectors(rows, rows)
    assert train.rdd.getNumPartitions() == 1 and [r.id for r in train.select("id").collect()] == list(range(1200))
    assert test.count() == 1200
    monkeypatch.setattr(session, "CELLS", 2000)
    assert session.fitted_rows(rows, 6).rdd.getNumPartitions() == 4
    assert session.fitted_rows(rows, 600).rdd.getNumPartitions() == 12
