"""Session helpers.

Library code never invents storage locations: lineage is cut with
``DataFrame.checkpoint()`` into the shared folder named by the cluster in
``spark.checkpoint.dir``. Only local/test sessions set that folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster job should carry too (AQE re-plans joins and splits skewed
# partitions at run time; the broadcast threshold is a size check on real stats).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}

CELLS = 2_000_000       # numbers in a partition of rows to fit on
ROWS = 200_000          # wide rows in a partition of a join


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sparkfeat", scratch: str | None = None) -> SparkSession:
    """Local session for tests and the bench; sets a scratch checkpoint dir."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in CLUSTER_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not _configured_dir(spark):
        scratch = scratch or tempfile.mkdtemp(prefix="sparkfeat-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", scratch)
        spark.sparkContext.setCheckpointDir(scratch)
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        return spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001 - unset key raises in some versions
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session without one (tests, benches) gets a scratch
    folder of its own; a cluster session without one is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    d = _configured_dir(spark)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster must name a shared folder")
        d = tempfile.mkdtemp(prefix="sparkfeat-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df):
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sparkfeat-{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df, name: str):
    """``df`` as Parquet files in the shared folder, read back; deleted when the application ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fitted_rows(df, width: int):
    """Checkpointed rows of ``width`` numbers each, for fits that pass over them many times.

    As many partitions as the rows fill with ``CELLS`` numbers, not as many as the (much
    larger) input they were derived from: a fit runs hundreds of small jobs, whose cost is the
    number of tasks while the rows are few. The order of the rows stays.
    """
    rows = cut_lineage(df)
    need = max(1, -(-rows.count() * max(width, 1) // CELLS))
    return rows if need >= rows.rdd.getNumPartitions() else cut_lineage(rows.coalesce(need))


def spread(df, rows: int, *keys):
    """``df`` dealt by ``keys`` to partitions of ``ROWS`` of its ``rows`` rows, where a shuffle would make fewer of them.

    Joins that follow by the same keys and rows sort no more in a task for a larger input.
    """
    need = rows // ROWS
    return df.repartition(need, *keys) if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def default_sf_dir() -> str:
    return os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
