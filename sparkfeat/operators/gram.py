"""Pairwise-complete correlations of many columns from one block Gram matrix (AGG-8..10).

Each task adds its rows up in matrices over all pairs of columns; blocks of their rows are
summed in a tree, and every block gives its pairs' correlations. The work per row is a few
matrix products and no expression grows with the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64       # columns in a block of the matrix
FAN = 64         # partial blocks added up by one task of the first level

SCHEMA = "block int, slot int, sums binary"


def _blocks(centre: np.ndarray):
    """Rows of a task to its partial blocks: six matrices (block's columns by all columns) over
    the rows where both columns have a value: pairs, sums and squares of either, products."""
    c = len(centre)

    def run(batches):
        total, slot = np.zeros((4, c, c)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            slot = batch.column(c)[0].as_py() // FAN
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(c)])
            here = ~np.isnan(x)                               # nulls and NaN alike are missing
            x, m = np.where(here, x - centre, 0.0), here.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        n, s, q, xy = total
        for lo in range(0, c, BLOCK):
            own = np.stack([w[lo:lo + BLOCK] for w in (n, s, s.T, q, q.T, xy)])
            yield _row((lo, slot), own.ravel())
    return run


def _row(key, sums):
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
                                       pa.array([sums.tobytes()], pa.binary())], names=["block", "slot", "sums"])


def _add(batches):
    """Rows sorted by (block, slot) to one row each with the sum of their matrices; one sum is held."""
    key = total = None
    for batch in batches:
        for here, raw in zip(zip(batch.column("block").to_pylist(), batch.column("slot").to_pylist()), batch.column("sums")):
            sums = np.frombuffer(raw.as_buffer(), float)
            if here == key:
                total += sums
                continue
            if key is not None:
                yield _row(key, total)
            key, total = here, sums.copy()
    if key is not None:
        yield _row(key, total)


def _correlations(cols):
    c = len(cols)

    def run(batches):
        for batch in batches:
            for lo, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                n, sx, sy, xx, yy, xy = np.frombuffer(raw, float).reshape(6, -1, c)
                with np.errstate(all="ignore"):
                    vx, vy, both = xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n
                    r = both / np.sqrt(vx * vy)
                # a spread that is rounding left over from the squares is none
                flat = (n < 2) | (vx <= 1e-13 * xx) | (vy <= 1e-13 * yy) | ~np.isfinite(r)
                a, b = np.nonzero(np.arange(c)[None, :] > lo + np.arange(n.shape[0])[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cols[lo + i] for i in a], pa.string()), pa.array([cols[j] for j in b], pa.string()),
                     pa.array(np.clip(r[a, b], -1, 1), pa.float64(), mask=flat[a, b])], names=["f1", "f2", "corr"])
    return run


def correlations(df: DataFrame, cols) -> DataFrame:
    """(f1, f2, corr) for every pair of columns, over the rows where both have a value.

    Null where fewer than two rows do, or where a column does not vary. Columns are centred on
    their means first, so large offsets cost no digits.
    """
    cols = list(cols)
    wide = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    known = [F.when(F.isnan(f"c{i}"), None).otherwise(F.col(f"c{i}")) for i in range(len(cols))]
    centre = np.array([v or 0.0 for v in wide.agg(*[F.avg(k) for k in known]).first()], float)
    # one more row without values: an empty table has its pairs, too
    wide = wide.unionAll(df.sparkSession.range(1).select(*[F.lit(None).cast("double") for _ in cols]))
    partial = wide.withColumn("slot", F.spark_partition_id()).mapInArrow(_blocks(centre), SCHEMA)
    for last in (False, True):
        if last:
            partial = partial.withColumn("slot", F.lit(0))
        partial = partial.repartition("block", "slot").sortWithinPartitions("block", "slot").mapInArrow(_add, SCHEMA)
    return partial.mapInArrow(_correlations(cols), "f1 string, f2 string, corr double")
