"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.session import checkpoint_dir

# The six ASCII white-space bytes of the word contract: tab..carriage return and space.
WHITE = b" \t\n\x0b\x0c\r"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing), keeps
    columns prunable and compressed, and is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    jvm.System.gc()      # lets Spark's cleaner delete the shuffle files of the finished job
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hpath = jvm.org.apache.hadoop.fs.Path(parent)
        hpath.getFileSystem(conf).delete(hpath, True)


def stowed(docs: DataFrame, but=()) -> tuple[list, list[str]]:
    """The columns of ``docs`` under internal names that clash with no other, and their own names.

    Columns named like one of ``but`` in any case (Spark does not tell cases apart) are left
    out: an operator's own output replaces them. ``toDF`` with the names brings the rest back.
    """
    out = {b.lower() for b in but}
    names = [c for c in docs.columns if c.lower() not in out]
    return [F.col("`" + c.replace("`", "``") + "`").alias(f"__k{i}") for i, c in enumerate(names)], names


# ------------------------------------------------------------------ batches and byte views

def slices(batches, rows: int = 1024):
    """The Arrow batches in small slices (no copy), so that a task's Python objects and
    temporaries stay small; hands unused Arrow memory back when the partition ends."""
    try:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)
    finally:
        pa.default_memory_pool().release_unused()


def byte_blocks(column, max_bytes: int = 1 << 20
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a text column into blocks of about ``max_bytes`` (one row at least).

    Yields (first row, end row, bytes, offsets relative to the block). Nulls
    read as empty. Numpy temporaries are a small multiple of a block.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False


def word_spans(buf: np.ndarray, offs: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of a block, and the row it belongs to."""
    n = len(buf)
    flag = np.empty(n + 1, bool)
    flag[:n] = _IS_WORD[buf]
    flag[n] = False
    start = flag[:n].copy()
    start[1:] &= ~flag[:n - 1] if n else start[1:]
    end = flag[:n] & ~flag[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = flag[inner]                  # a row starts a word of its own
    end[inner - 1] = flag[inner - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64-bit values (splitmix constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = {0: 0x9E3779B97F4A7C15, 1: 0xD1342543DE82EF95}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 18)
        base = _BASE[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _POWERS[which] = (out[0], out[1])
    return have


class RangeHash:
    """Hash of any range of a value sequence in O(1) after one cumulative sum."""

    def __init__(self, values: np.ndarray, which: int = 0):
        p, self.inv = _powers(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * p[:len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start]
                     + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHash(_BYTE_VALUE[buf])(starts, ends)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return op(x[:-rest], x[rest:]) if rest else x
