"""Fold assignment (CV-1..4), repeatable whatever the partitioning.

* plain k-fold (CV-2): ``pmod(hash32(seed, id), k)``.
* stratified k-fold (CV-1): rows of each class ordered by (hash, id); the
  i-th row (0-based) goes to fold ``i mod k`` — per-class fold sizes differ
  by at most one. The within-class position comes from ``rank_by_hash``
  (hash-range buckets + offsets), never from a one-task window.
* group k-fold (CV-3): fold from the hash of the group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import hash32, sql_hash32
from sparkfeat.functions.ordered import rank_by_hash


def hash_fold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42,
              out: str = "fold") -> DataFrame:
    """CV-2: shuffled plain k-fold."""
    return df.withColumn(out, F.pmod(hash32(id_col, seed), F.lit(k)).cast("int"))


def stratified_fold(df: DataFrame, id_col: str, label_col: str, k: int = 5,
                    seed: int = 42, out: str = "fold", n_buckets: int = 1 << 16) -> DataFrame:
    """CV-1: shuffled stratified k-fold (exact, distributed)."""
    tagged = df.withColumn("__h", hash32(id_col, seed))
    ranked = rank_by_hash(tagged, [label_col], "__h", id_col, n_buckets, out="__rk")
    return (ranked.withColumn(out, F.pmod(F.col("__rk") - 1, F.lit(k)).cast("int"))
            .drop("__h", "__rk"))


def group_fold(df: DataFrame, group_col: str, k: int = 5, seed: int = 42,
               out: str = "fold") -> DataFrame:
    """CV-3 (group variant): every row of a group lands in the same fold."""
    return df.withColumn(out, F.pmod(hash32(group_col, seed, "group"), F.lit(k)).cast("int"))


def fold_sets(df: DataFrame, id_col: str, label_col: str | None, k: int = 5,
              seeds=(42, 43, 44), kinds=None, prefix: str = "fold_") -> DataFrame:
    """CV-3: repeated (stratified or plain) folds, one column per seed."""
    kinds = kinds or ["stratified" if label_col else "plain"] * len(seeds)
    out = df
    for i, (s, kind) in enumerate(zip(seeds, kinds), start=1):
        if kind == "stratified":
            out = stratified_fold(out, id_col, label_col, k, s, f"{prefix}{i}")
        else:
            out = hash_fold(out, id_col, k, s, f"{prefix}{i}")
    return out


def per_source_fold(df: DataFrame, id_col: str, label_col: str, source_col: str,
                    k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """CV-4: stratified folds drawn separately inside each source table."""
    tagged = df.withColumn("__h", hash32(id_col, seed))
    ranked = rank_by_hash(tagged, [source_col, label_col], "__h", id_col, out="__rk")
    return (ranked.withColumn(out, F.pmod(F.col("__rk") - 1, F.lit(k)).cast("int"))
            .drop("__h", "__rk"))


# SQL twins for the oracle
def sql_hash_fold(id_sql: str, k: int = 5, seed: int = 42) -> str:
    return f"CAST({sql_hash32(id_sql, seed)} % {k} AS INTEGER)"


def sql_strat_fold(id_sql: str, label_sql: str, k: int = 5, seed: int = 42) -> str:
    return (f"CAST((row_number() OVER (PARTITION BY {label_sql} ORDER BY "
            f"{sql_hash32(id_sql, seed)}, {id_sql}) - 1) % {k} AS INTEGER)")
