"""op12 against brute force; the planar bound against sampled spheres."""

import hashlib
import math

import numpy as np
import pytest
from sparkfeat.llm import spheres as S

COLUMNS = "vec_id long, embedding array<double>, block long, cluster string, Ids int"


def brute(rows, k, rounds, dims):
    good = [(i, tuple(math.floor(1024 * x) for x in e)) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2 ** 27 for x in e)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [c for _, c in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in good]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(good, own) if o == j]
            if mine:
                cs[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    final = [(i, *near(v)[::-1]) for i, v in good]
    per = {j: sum(d for _, c, d in final if c == j) for j in range(len(cs))}
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest())
                   for i, c, d in final), key=str)


def run(spark, rows, k=8, rounds=10, dims=4, log=None):
    df = spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], COLUMNS).repartition(3)
    return sorted((tuple(r) for r in S.sphere_clusters(df, k, rounds, dims, log=log).collect()), key=str)


def odd(dims):
    zero = [0.0] * dims
    return [(9001, None), (9002, [None, *zero[1:]]), (9003, [float("nan"), *zero[1:]]), (9004, [float("inf"), *zero[1:]]),
            (9005, zero[1:]), (9006, [*zero, 0.0]), (9007, []), (9008, [1e300, *zero[1:]]), (None, zero), (None, zero), (7, zero), (7, zero)]


@pytest.mark.parametrize("spread,large", [(0.01, 1), (1.0, 1), (1.0, 500)])
def test_brute_force(spark, spread, large):
    rng = np.random.default_rng(3)
    means = rng.normal(size=(5, 4))
    rows = [(int(i), (large * (means[i % 5] + spread * e)).tolist()) for i, e in enumerate(rng.normal(size=(400, 4)))] + odd(4)
    assert run(spark, rows) == brute(rows, 8, 10, 4)


def test_few_rows_ties_and_empty(spark):
    assert run(spark, []) == [] and run(spark, odd(4)[:8]) == []
    for rows in ([(5, [0.5] * 4)], [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(40)], odd(4), [(None, [1.0] * 4)] * 3):
        assert run(spark, rows) == brute(rows, 8, 10, 4)
    assert run(spark, [(i, [float(i)] * 4) for i in range(30)], k=1) == brute([(i, [float(i)] * 4) for i in range(30)], 1, 10, 4)


def test_many_blocks_join_without_shuffling_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = np.random.default_rng(1)
        rows = [(int(i), e.tolist()) for i, e in enumerate(rng.normal(size=(500, 4)))]
        log = []
        assert run(spark, rows, k=5, rounds=6, log=log) == brute(rows, 5, 6, 4)
        assert log[0] == 500 and all(n < 500 for n in log[1:])
        a = S._Bucketed(spark.range(40).selectExpr("id AS block", "id AS x"), 8, "a")
        b = S._Bucketed(spark.range(40).selectExpr("id AS block", "id AS y"), 8, "b")
        joined = a.df().join(b.df(), "block")
        assert joined.count() == 40
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        a.drop()
        b.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_planar_bound_holds_and_is_below_the_drift():
    rng = np.random.default_rng(0)
    below = 0
    for _ in range(300):
        dims = int(rng.integers(2, 9))
        centre, old = rng.normal(size=(2, dims)) * rng.choice([1, 5, 20])
        new, radius = old + rng.normal(size=dims) * rng.choice([0.01, 1, 5]), float(rng.uniform(0, 3))
        way = rng.normal(size=(4000, dims))
        x = centre + radius * way / np.linalg.norm(way, axis=1)[:, None] * rng.choice([1, 1, 0.5], size=(4000, 1))
        real = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        bound, drift = S.gain(centre, radius, old, new), np.linalg.norm(new - old)
        assert real <= bound + 1e-9 and bound <= drift * (1 + 1e-12)
        below += bound < 0.9 * drift
    assert below > 100
