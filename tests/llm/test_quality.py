"""op9: held-out accuracy, inputs and edges."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfeat.llm.common import table
from sparkfeat.llm.quality import FEATURES, block_features, fit, op9_quality_gam, score_quality, train_quality

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    got = op9_quality_gam(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_features_do_not_depend_on_neighbours():
    texts = ["", "One two THREE.\nOne two THREE.\nshort", "é ü, ñ!! ### |", "same line here\nother line x\nsame line here", "a " * 50, "\n\n", "x" * 300]
    raws = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raws)])
    joint = block_features(np.frombuffer(b"".join(raws), np.uint8), offs)
    assert joint.shape == (7, len(FEATURES)) and np.isfinite(joint).all()
    for k, r in enumerate(raws):
        alone = block_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert (joint[k] == alone[0]).all()


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > .5) ^ (x[:, 1] > .5)).astype(float)
    model = fit(x[:3000], y[:3000], rounds=10, pair_rounds=40)
    assert ((model.score(x[3000:]) > .5) == y[3000:]).mean() > 0.95
    assert (1, 0) in model.pairs


def test_edges(spark):
    docs = spark.createDataFrame([(1, "fine text here", 1.0), (2, None, 2.0), (3, "", 3.0), (None, "x", 4.0), (1, "fine text here", 1.0), (4, "w " * 200_000, 0.0)],
                                 "doc_id long, text string, x double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = train_quality(docs, none)
    scored = score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "x", "__score"]
    assert scored.count() == 6 and scored.where("__score between 0 and 1").count() == 6
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1)], "doc_id long, quality int")
    assert score_quality(docs, train_quality(docs, one)).count() == 6
    assert score_quality(docs.limit(0), model).count() == 0
    assert scored.where(F.col("__score").isNull()).count() == 0
