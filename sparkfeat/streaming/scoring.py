"""Stream = batch scoring.

The reference has no streaming; what carries over is that every fitted
transform is stateless (expressions + a broadcast lookup), so the same
transform applies unchanged to a ``readStream`` DataFrame. The stream is a
file source; output goes to a parquet sink in the shared checkpoint folder
(no driver-side memory sink), with its own checkpoint for exactly-once
restarts after executor or driver loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.lookup import State, fit_state
from sparkfeat.session import shared_path

EVENT_SCHEMA = ("event_id bigint, ts timestamp, user_id bigint, event_type string, "
                "value double, props string")


class EventScorer:
    """Fitted on a batch of events: smoothed mean value per event type and
    the overall moments of ``value``; ``transform`` works on batch and stream."""

    def __init__(self, alpha: float = 10.0):
        self.alpha = alpha
        self.state: State | None = None
        self.mean = self.std = None

    def fit(self, events: DataFrame) -> "EventScorer":
        row = events.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
        self.mean, self.std = row["m"], row["s"]
        a = F.lit(self.alpha)
        stats = events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        table = stats.select(F.col("event_type").alias("__t"),
                             ((F.col("s") + a * F.lit(self.mean)) / (F.col("n") + a)).alias("type_mean"))
        self.state = fit_state(table)
        return self

    def transform(self, events: DataFrame) -> DataFrame:
        st = F.broadcast(self.state.df) if self.state.small else self.state.df
        j = events.join(st, events.event_type == st["__t"], "left").drop("__t")
        z = F.try_divide(F.col("value") - F.lit(self.mean), F.lit(self.std))
        return j.select("event_id", "event_type", "value",
                        F.coalesce(F.col("type_mean"), F.lit(self.mean)).alias("type_mean"),
                        z.alias("value_z"), (z > 2.0).alias("is_high"))


def run_file_stream(spark: SparkSession, table_path: str, schema, transform, files_per_batch: int = 1000) -> DataFrame:
    """``transform`` (an action-free function of a DataFrame) over a parquet table (one file, or a
    folder of part files) as a stream until the input is drained; the written rows."""
    base = shared_path(spark, "stream")
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(path).isDirectory():
        stream = reader.parquet(table_path)
    else:                       # a file source reads folders: the table's own, with this one name
        stream = reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    out = transform(stream)
    q = (out.writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def score_file_stream(spark: SparkSession, scorer: EventScorer, table_path: str,
                      files_per_batch: int = 1000) -> DataFrame:
    """Run the scorer over an events table as a stream until the input is drained."""
    return run_file_stream(spark, table_path, EVENT_SCHEMA, scorer.transform, files_per_batch)
