"""Lookups, row sets and sampling (JOI-1..3, SET-1..4, SMP-1..2).

Sampling is hash-based, so a sample is the same whatever the partitioning
and after any retry (``randomSplit`` / ``sample`` depend on partitioning).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import TWO32, hash32
from sparkfeat.functions.lookup import fit_state, lookup_join
from sparkfeat.functions.ordered import top_n


def lookup_with_default(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str,
                        default, id_col: str, out: str | None = None) -> DataFrame:
    """JOI-1: category → value with a default for unknown / missing keys.

    A key that stands more than once in ``table`` has its smallest value.
    """
    st = fit_state(table.groupBy(F.col(table_key).alias("__k")).agg(F.min(value).alias("__v")))
    j = lookup_join(df, st, [(key, "__k")], salt_col=id_col)
    return j.withColumn(out or value, F.coalesce(F.col("__v"), F.lit(default))).drop("__v")


def concat_by_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """JOI-2/3: column concatenation aligned on the row id."""
    return left.join(right, key, how)


def append_rows(*frames: DataFrame) -> DataFrame:
    """SET-1: rows aligned by column name; absent columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_split(train: DataFrame, test: DataFrame, split_col: str = "split") -> DataFrame:
    """SET-2: one table with a split marker (fit shared encoders, filter back)."""
    return append_rows(train.withColumn(split_col, F.lit("train")),
                       test.withColumn(split_col, F.lit("test")))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """SET-3."""
    return append_rows(*frames).distinct()


def id_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """SET-4: ids of ``a`` that also occur in ``b`` (semi join, no duplicates)."""
    return a.select(key_a).distinct().join(b.select(F.col(key_b).alias(key_a)), key_a, "left_semi")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """SMP-1: n rows without replacement, repeatable (the smallest hashes of the id).

    Hashes are uniform, so the cut-off is known up to a margin before any row is looked at:
    a filter on the hash leaves little more than n rows (all rows, should it leave fewer).
    """
    total = df.count()
    if total <= n:
        return df
    tagged = df.withColumn("__h", hash32(id_col, seed, "sample"))
    near = tagged.filter(F.col("__h") < F.lit((n + 8 * math.sqrt(n) + 8) / total * TWO32))
    return top_n(near if near.count() >= n else tagged, "__h", id_col, n, descending=False).drop("__h")


def holdout_split(df: DataFrame, id_col: str, test_pct: int = 20, seed: int = 42,
                  out: str = "is_valid") -> DataFrame:
    """SMP-2: hash bucket < test_pct of 100 → validation row."""
    return df.withColumn(out, F.pmod(hash32(id_col, seed, "split"), F.lit(100)) < test_pct)
