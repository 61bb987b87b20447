"""Block Gram correlations and exact KS p-values."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from sparkfeat.functions.kolmogorov import ks_exact_p
from sparkfeat.operators import gram
from sparkfeat.operators import profile as P


@pytest.mark.parametrize("block,parts", [(64, 3), (5, 9)])
def test_correlations_match_pandas(spark, monkeypatch, block, parts):
    monkeypatch.setattr(gram, "BLOCK", block)
    monkeypatch.setattr(gram, "FAN", 2)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)) + 1e6 * np.arange(12)
    x[:, 3] = 2 * x[:, 2] + rng.normal(size=300) * 0.01
    x[:, 4] = 7.25
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = np.nan
    x[2:, 6] = np.nan
    frame = pd.DataFrame(x, columns=[f"v.{i}" if i == 1 else f"v{i}" for i in range(12)])
    df = spark.createDataFrame([tuple(None if math.isnan(v) and i % 2 else v for v in r) for i, r in enumerate(x.tolist())],
                               ", ".join(f"`{c}` double" for c in frame.columns)).repartition(parts)
    df = df.withColumnRenamed("v.1", "v1")
    frame = frame.rename(columns={"v.1": "v1"})
    got = {(r.f1, r.f2): r.corr for r in P.corr_long(df, list(frame.columns)).collect()}
    want = frame.corr(min_periods=2)
    assert list(sorted(got)) == sorted(combinations(frame.columns, 2))
    for (a, b), v in got.items():
        if {a, b} & {"v4", "v5"}:
            assert v is None
        elif "v6" in (a, b):
            assert v is None or abs(v) > 0.999999             # two rows at most
        else:
            assert v == pytest.approx(want.loc[a, b], abs=1e-9)


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [tuple(r) for r in P.corr_long(df, ["a", "b"]).collect()] == [("a", "b", None, False)]
    assert [tuple(r) for r in P.corr_long(df.limit(0), ["a", "b"]).collect()] == [("a", "b", None, False)]


def test_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 150))
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"c{i}" for i in range(150)])).repartition(4)
    got = {(r.f1, r.f2): r.corr for r in P.corr_long(df, df.columns).collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 150 * 149 // 2
    assert max(abs(got[f"c{a}", f"c{b}"] - want[a, b]) for a, b in combinations(range(150), 2)) < 1e-9


def paths(n1, n2, reach):
    """Share of all orders of the pooled sample that reach the statistic, by enumeration."""
    hit = total = 0
    for at in combinations(range(n1 + n2), n1):
        i = j = 0
        met = False
        for s in range(n1 + n2):
            i, j = (i + 1, j) if s in at else (i, j + 1)
            met |= abs(i * n2 - j * n1) >= reach
        hit, total = hit + met, total + 1
    return hit / total


@pytest.mark.parametrize("n1,n2", [(1, 1), (3, 4), (5, 5), (2, 7), (6, 4)])
def test_exact_p_by_enumeration(n1, n2):
    for reach in range(n1 * n2 + 2):
        assert ks_exact_p(n1, n2, reach) == pytest.approx(paths(n1, n2, reach), abs=1e-12)


def test_exact_p_closed_form_for_equal_sizes():
    for n, h in ((50, 7), (500, 60), (3000, 40)):
        log = math.lgamma
        want = 2 * sum((-1) ** (k + 1) * math.exp(2 * log(n + 1) - log(n - k * h + 1) - log(n + k * h + 1)) for k in range(1, n // h + 1))
        assert ks_exact_p(n, n, h * n) == pytest.approx(want, rel=1e-8)


def test_the_switch_to_the_asymptotic_value(spark):
    df = spark.createDataFrame([(float(i), i % 3 == 0) for i in range(60)], "x double, side boolean")
    exact, asymptotic = (P.ks_two_sample(df, ["x"], "side", exact_up_to=n).first() for n in (40, 39))
    assert (exact.n_a, exact.n_b, exact.d) == (40, 20, asymptotic.d) and exact.p_value != asymptotic.p_value
    assert exact.p_value == pytest.approx(ks_exact_p(40, 20, round(exact.d * 800)))
