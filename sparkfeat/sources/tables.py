"""Scans (SRC-1..3): parquet / CSV readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table by name (one parquet file per table)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType, corrupt_column: str | None = None) -> DataFrame:
    """SRC-1: CSV with header and a declared schema (no inference pass).

    A row that does not fit the schema stops the read, or, with
    ``corrupt_column``, is kept there as text; it never turns to nulls unseen.
    """
    reader = spark.read.option("header", True)
    if corrupt_column is None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    return (reader.schema(StructType([*schema.fields, StructField(corrupt_column, StringType())]))
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column).csv(path))


def read_union_distinct(*frames: DataFrame) -> DataFrame:
    """SRC-2 / SET-3: concatenate sources by column name, drop exact duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct()


def read_split(spark: SparkSession, path: str, pseudo_flag: str = "is_pseudo",
               keep_pseudo: bool = False) -> DataFrame:
    """SRC-3: feature table, optionally without pseudo rows (filter reaches the scan)."""
    from pyspark.sql import functions as F
    df = spark.read.parquet(path)
    if not keep_pseudo and pseudo_flag in df.columns:
        df = df.filter(~F.col(pseudo_flag))
    return df
