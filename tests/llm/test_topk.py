"""op4 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfeat.llm.topk import top_k, tree_of, tree_order


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in e]) for i, e in rows
            if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in dict(good).items():
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))
            out += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, k, **more):
    df = spark.createDataFrame([(i, e, 3) for i, e in rows], "vec_id long, embedding array<double>, rank int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k, **more).collect())


@pytest.mark.parametrize("seed,shard,block", [(0, 2048, 512), (1, 40, 7), (2, 150, 3)])
def test_random(spark, seed, shard, block):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(700, 6)) * (0.05 if seed == 1 else 1)       # small values: many ties
    rows = [(int(i) * 3, e.tolist()) for i, e in enumerate(x)] + [(9999 * 20, None), (20_020, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
                                                                    (20_040, [float("nan")] * 6), (20_060, [float("inf")] * 6),
                                                                    (None, [0.0] * 6), (20_080, [0.5, 0.5]), (20_081, [1.0, -1.0]), (20_100, [0.1])]
    assert run(spark, rows, 20, shard=shard, block=block) == brute(rows, 20)


def test_repeats_few_rows_and_empty(spark):
    rows = [(20, [1.0, 2.0]), (21, [1.0, 2.0]), (21, [1.0, 2.0]), (22, [0.0, 0.0])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [(20, [1.0])], 5) == []
    assert run(spark, [(21, [1.0])], 5) == []
    assert run(spark, [], 5) == []


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2 ** 24 + i), float(2 ** 20 * (i % 3))]) for i in range(60)]
    assert run(spark, rows, 10, shard=16) == brute(rows, 10)


def test_hot_vector_is_cut_into_pieces(spark):
    rows = [(7, [1.0, 0.5])] * 500 + [(i, [i / 100, 0.2]) for i in range(100)]
    assert run(spark, rows, 20, shard=50) == brute(rows, 20)


def test_vectors_without_components(spark):
    rows = [(i, []) for i in range(300)]
    assert run(spark, rows, 5, shard=200) == brute(rows, 5)


def test_boxes_are_tight():
    x = np.random.default_rng(0).integers(-9, 9, (500, 4)).astype(float)
    order = tree_order(x)
    parent, first, past, leaf, low, high = tree_of(x[order])
    assert sorted(order) == list(range(500)) and leaf.sum() >= 8
    for k in range(len(parent)):
        own = x[order[first[k]:past[k]]]
        assert (own.min(0) == low[k]).all() and (own.max(0) == high[k]).all()
