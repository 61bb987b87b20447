"""Connected components over an edge table (long vertex ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges(a, b)``; label = smallest vertex reachable.

    Each round passes the smallest label over all edges (combined before the
    shuffle) and then jumps to the label of the label, so the rounds grow with
    the logarithm of the longest chain. Both joins stand between exchanges of
    written tables: a vertex with very many edges is split by adaptive execution.
    """
    both = materialize(edges.where("a <> b").select("a", "b")
                       .unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v"))
                         .agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        passed = both.join(labels, both.a == labels.v).select(F.col("b").alias("v"), "label")
        passed = passed.withColumn("old", F.lit(None).cast("long"))
        step = materialize(labels.select("v", "label", F.col("label").alias("old")).unionAll(passed)
                           .groupBy("v").agg(F.min("label").alias("label"), F.max("old").alias("old")), "step")
        drop_materialized(labels)
        if step.where("label <> old").isEmpty():
            drop_materialized(both)
            return step.select("v", "label")
        up = step.select(F.col("v").alias("p"), F.col("label").alias("up"))
        labels = materialize(step.join(up, step.label == up.p)
                             .select("v", F.least("label", "up").alias("label")), "labels")
        drop_materialized(step)
