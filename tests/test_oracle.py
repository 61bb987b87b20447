"""Layer 1: every SQL-expressible query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import frame_hash, norm_frame

SQL = entry.oracle_sql()
ALL = entry.queries()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"id", "fold", "pri_oof"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    got = norm_frame(ALL[name](spark, SF_SMALL).toPandas())
    want = norm_frame(duck.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_query_names_are_descriptive():
    import re

    from sparkfeat import catalog
    for name in catalog.queries():
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
        assert "pipeline" not in name and not re.match(r"op\d+_", name)
