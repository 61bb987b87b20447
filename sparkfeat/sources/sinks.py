"""Sinks (SNK-1..4): feature tables, metrics JSON, prediction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet") -> None:
    """SNK-1: train and test side by side (partitioned by the split flag)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-2: metrics as JSON lines (Spark types are JSON-safe already), one file;
    the few rows are shuffled, so the stage that computes them keeps its tasks."""
    metrics.repartition(1).write.mode("overwrite").json(path)


def compare_metrics(spark: SparkSession, new: DataFrame, old_path: str, key: str = "metric",
                    value: str = "value") -> DataFrame:
    """SNK-3: join new metrics to a stored run and report deltas."""
    old = spark.read.json(old_path).select(F.col(key), F.col(value).alias("old_value"))
    return (new.join(old, key, "left")
            .withColumn("delta", F.col(value) - F.col("old_value")))


def prediction_frame(scored: DataFrame, id_col: str, p_col: str, positive: str, negative: str,
                     label_col: str = "label", inclusive: bool = False) -> DataFrame:
    """SNK-4: (id, label text) from probabilities."""
    cond = F.col(p_col) >= 0.5 if inclusive else F.col(p_col) > 0.5
    return scored.select(id_col, F.when(cond, positive).otherwise(negative).alias(label_col))


def write_predictions(pred: DataFrame, path: str) -> None:
    pred.write.mode("overwrite").option("header", True).csv(path)
