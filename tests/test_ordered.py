"""Radix cut-offs, ranges, quantiles and rank lookup against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkfeat.functions import ordered as O
from sparkfeat.operators import features as X
from sparkfeat.operators import profile as P
from sparkfeat.operators.sets import sample_n


@pytest.mark.parametrize("few", [10_000, 0])
def test_radix_cut_on_any_longs(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW", few)
    rng = random.Random(1)
    values = [rng.choice([-2 ** 63, 2 ** 63 - 1, 0, 5, rng.randrange(-10, 10), rng.randrange(2 ** 62)]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "k long")
    order = sorted(values)
    for n in (1, 57, 200, 399, 400):
        cut = order[n - 1]
        assert O.radix_cut(df, "k", n) == (cut, sum(v < cut for v in values), values.count(cut))
    assert O.radix_cut(df, "k", 401) is None


@pytest.mark.parametrize("kind", ["double", "float", "decimal(38,18)", "int", "date", "timestamp"])
@pytest.mark.parametrize("descending", [True, False])
def test_top_n_of_every_type(spark, monkeypatch, kind, descending):
    monkeypatch.setattr(O, "FEW", 20)
    if kind in ("double", "float"):
        values = [0.0, -0.0, 1e-30, -1e30, 7.5, -7.5, float("inf"), float("-inf"), None, 1e300 if kind == "double" else 1e30] * 12
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    else:
        rows = spark.range(120).selectExpr("id", {
            "int": "if(id % 11 = 0, null, cast(pmod(id * 37, 50) as int)) AS v",
            "date": "date_add(date'1969-12-25', cast(pmod(id * 37, 50) as int)) AS v",
            "timestamp": "timestamp_micros(pmod(id * 37, 50) - 25) AS v",
            "decimal(38,18)": "cast(1 as decimal(38,18)) + cast(pmod(id * 37, 50) as decimal(38,18)) / cast(1000000000000000000 as decimal(38,0)) AS v"}[kind])
    df = rows.select("id", F.col("v").cast(kind).alias("v"))
    order = F.desc_nulls_last("v") if descending else F.asc_nulls_last("v")
    for n in (1, 13, 60, 119):
        want = [r.id for r in df.orderBy(order, "id").limit(n).collect()]
        assert sorted(r.id for r in O.top_n(df, "v", "id", n, descending).collect()) == sorted(want)


def test_sample_is_the_smallest_hashes(spark):
    from sparkfeat.functions.hashing import hash32
    df = spark.range(5000).selectExpr("id", "id * 2 AS x")
    for n in (1, 40, 4990, 5000, 6000):
        want = {r.id for r in df.orderBy(hash32("id", 42, "sample"), "id").limit(n).collect()}
        assert {r.id for r in sample_n(df, "id", n).collect()} == want


def test_row_positions(spark):
    rows = [(random.Random(i).randrange(20), i) for i in range(300)]
    got = O.row_positions(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "at", "n").collect()
    assert sorted((r.a, r.b, r["at"], r.n) for r in got) == [(a, b, i, 300) for i, (a, b) in enumerate(sorted(rows))]


def test_quantiles_by_group_stay_distributed(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 7 == 0 else f"g{i % 90}", float(v), None if i % 90 == 5 else float(i % 4)) for i, v in enumerate(rng.normal(size=2000))]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r.feature, r.grp): r for r in P.five_number(df, ["x", "y"], "g").collect()}
    for g in {r[0] for r in rows}:
        for c, at in (("x", 1), ("y", 2)):
            own = [r[at] for r in rows if r[0] == g and r[at] is not None]
            if own:
                want = np.percentile(own, [0, 25, 50, 75, 100])
                assert np.allclose([got[c, g][k] for k in ("min", "q25", "q50", "q75", "max")], want)
            else:
                assert (c, g) not in got


def test_rank_of_unseen_values(spark):
    fit = spark.createDataFrame([(i, float(v), None) for i, v in enumerate([1, 2, 2, 5, 9])], "id long, x double, y double")
    new = spark.createDataFrame([(7, 0.0, 1.0), (7, 2.0, 1.0), (8, 3.0, None), (9, 5.0, 2.0), (10, 99.0, 1.0), (11, None, 1.0)],
                                "id long, x double, y double")
    got = sorted((r.id, r.x is None, r.x or 0, r.x_rank, r.y_rank) for r in X.pct_rank(new, ["x", "y"], "id", fit_on=fit).collect())
    ranks = [0.1, 0.5, 0.7, 0.8, 1.0, None]
    assert [r[3] for r in got] == [pytest.approx(v) if v is not None else None for v in ranks]
    assert all(r[4] is None for r in got)


def test_edge_inputs_give_null_or_zero(spark):
    from sparkfeat.operators.text import low_info_report
    df = spark.createDataFrame([(1, "a", 7, None), (2, "b", 1, None), (3, "c", None, None)], "id int, g string, v int, t string")
    cross = {r.g: (r.n, r.share_0, r.share_1) for r in P.crosstab_share(df, "g", "v", [0, 1]).collect()}
    assert cross == {"a": (1, 0.0, 0.0), "b": (1, 0.0, 1.0), "c": (0, 0.0, 0.0)}
    one = df.filter("id = 1").select("id", F.col("v").cast("double").alias("v"), F.lit(None).cast("double").alias("w"))
    moments = X.fit_moments(one, ["v", "w"])
    assert one.select(X.high_flag("v", moments), X.high_flag("w", moments)).first() == (0, 0)
    assert {(r.feature, r.stat, r.kept) for r in low_info_report(df, ["t"], []).collect()} == {("t", 0.0, False)}
    assert math.isclose(P.crosstab_share(df, "g", "v", [7]).filter("g = 'a'").first().share_7, 1.0)
