"""Line deduplication by range-partitioned hashes and keep bitmaps.

Every long enough line becomes (hash, document, line numbers), once per document.
Those rows are range-partitioned by (hash, document descending) and sorted, so a
task streams each line's documents from the largest on: the first one keeps its
lines, later ones lose theirs once a third document has been seen. A partition
may begin or end inside a line's rows (a hot line spans many partitions); those
rows are handed on with the three largest documents each partition saw, and a
table of at most two lines per partition settles them. The result is one
compressed keep bitmap per document; texts never enter the sort.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import WHITE, byte_blocks, materialize, slices, stowed, table


def _lines_of(min_chars):
    def keys(block):
        """Line numbers by key hash for one text (A-Z folded, white space stripped)."""
        out = {}
        for number, line in enumerate(block.lower().split(b"\n")):
            line = line.strip(WHITE)
            if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
                out.setdefault(xxhash.xxh3_128_digest(line), []).append(number)
        return out

    def run(batches):
        for batch in slices(batches):
            for lo, hi, buf, offs in byte_blocks(batch.column("text")):
                raw = buf.tobytes()
                digests, rows, lines = [], [], []
                for row, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
                    for digest, numbers in keys(raw[a:b]).items():
                        digests.append(digest)
                        rows.append(lo + row)
                        lines.append(numbers)
                if not rows:
                    continue
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column("doc_id").take(at),
                     batch.column("tk").take(at), pa.array(lines, pa.list_(pa.int32()))],
                    names=["h1", "h2", "doc_id", "tk", "lines"])
    return run


STREAM_SCHEMA = "open boolean, seen int, rank int, h1 long, h2 long, doc_id long, tk long, lines array<int>"


def _stream_of(min_docs):
    """Lines to drop from one sorted partition; rows of its first and last line stay open.

    State: the rows of the current line's first ``min_docs`` - 1 documents.
    """
    def run(batches):
        out, held = [], []           # held: rows of the line not decided yet
        key, docs, last, opening = None, 0, None, True

        def emit():
            nonlocal out
            cols = list(zip(*out))
            out = []
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["open", "seen", "rank", "h1", "h2", "doc_id", "tk", "lines"])

        for batch in slices(batches):
            for h1, h2, doc, tk, lines in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "tk", "lines"))):
                if (h1, h2) != key:
                    if key is not None:
                        opening = False
                    key, docs, last = (h1, h2), 0, None
                    held.clear()
                if doc != last:
                    docs, last = docs + 1, doc
                row = (docs, h1, h2, doc, tk, lines)
                if opening:
                    out.append((True, 0, *row))
                elif docs < min_docs:
                    held.append(row)             # min_docs - 1 documents at most
                else:
                    out += [(False, 0, *r) for r in held if r[0] > 1]
                    held[:] = [r for r in held if r[0] == 1]
                    out.append((False, 0, *row))
                if len(out) >= 4096:
                    yield emit()
        # The last line may go on in the next partition: its undecided rows stay open.
        # Rows dropped already are right whatever follows, as later documents are smaller;
        # the largest document's rows go on, with the number of documents seen here.
        out += [(True, docs, *r) for r in held]
        if out:
            yield emit()
    return run


def line_keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, tk, n_lines, n_dropped, keep) for every distinct (doc_id, text).

    A line's key is the line without white space at both ends, A-Z folded. Keys of
    at least ``min_chars`` code points found in at least ``min_docs`` documents are
    dropped everywhere but in the largest doc_id that holds them (all its lines
    stay). ``keep``: zlib-compressed bits, one per line, first line first.
    Null and empty texts are one empty line. Rows that share a doc_id count as one
    document; rows with a null doc_id are never counted and lose nothing.
    ``tk`` tells texts of one doc_id apart. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.withColumn("tk", F.xxhash64("text"))
    lines = docs.where("doc_id is not null").mapInArrow(
        _lines_of(min_chars), "h1 long, h2 long, doc_id long, tk long, lines array<int>")
    lines = materialize(lines, "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", F.col("doc_id").desc(), "tk"]
    # Partitions may shift when a lost executor makes Spark sort again, so the stream is written once.
    seen = materialize(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .mapInArrow(_stream_of(min_docs), STREAM_SCHEMA), "line-stream")
    # At most two lines per partition, min_docs documents each: size bounded by the partitions.
    settled = (seen.where(F.col("open") & (F.col("rank") <= min_docs)).groupBy("h1", "h2")
               .agg(F.max("doc_id").alias("largest"),
                    F.greatest(F.size(F.collect_set("doc_id")), F.max("seen")).alias("docs"))
               .where(F.col("docs") >= min_docs).select("h1", "h2", "largest"))
    opened = (seen.where("open").join(F.broadcast(settled), ["h1", "h2"])
              .where("doc_id < largest").select("doc_id", "tk", "lines"))
    gone = (seen.where("not open").select("doc_id", "tk", "lines").unionAll(opened)
            .groupBy("doc_id", "tk").agg(F.flatten(F.collect_list("lines")).alias("gone")))
    every = (docs.select("doc_id", "tk", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
             .groupBy("doc_id", "tk").agg(F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("n_lines")))
    return (every.join(gone, ["doc_id", "tk"], "left")
            .mapInArrow(_bitmaps, "doc_id long, tk long, n_lines long, n_dropped long, keep binary"))


def _bitmaps(batches):
    for batch in slices(batches):
        dropped, keep = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            bits = np.ones(n, np.uint8)
            if gone:
                bits[gone] = 0
            dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tk"), batch.column("n_lines"),
             pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())],
            names=["doc_id", "tk", "n_lines", "n_dropped", "keep"])


def _kept_of(digest):
    def run(batches):
        for batch in slices(batches):
            kept = []
            for text, n, dropped, keep in zip(*(batch.column(c).to_pylist() for c in ("__text", "n_lines", "n_dropped", "keep"))):
                if dropped:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n]
                    text = "\n".join(line for line, b in zip(text.split("\n"), bits.tolist()) if b)
                kept.append(hashlib.sha256((text or "").encode()).hexdigest() if digest else text)
            names = [c for c in batch.schema.names if c not in ("__text", "keep")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kept, pa.string())],
                                             names=[*names, "__kept"])
    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  digest: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, n_lines, n_dropped and ``__kept``: the kept
    text (null stays null) or, with ``digest``, its SHA-256. Columns of ``docs`` named like one
    of these three, in any case, are replaced."""
    own = ("n_lines", "n_dropped", "__kept")
    kept, names = stowed(docs, (text, *own))
    left = docs.select(*kept, F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
    right = bitmaps.select(F.col("doc_id").alias("__of"), F.col("tk").alias("__tk"), "n_lines", "n_dropped", "keep")
    joined = left.join(right, F.col("__id").eqNullSafe(F.col("__of")) & (F.xxhash64("__text") == F.col("__tk"))).drop("__id", "__of", "__tk")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("__text", "keep")]
    return joined.mapInArrow(_kept_of(digest), ", ".join([*fields, "__kept string"])).toDF(*names, *own)


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_bitmaps(docs, line_keep_bitmaps(docs), digest=True).select(
        "doc_id", "n_lines", "n_dropped", F.col("__kept").alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN hot USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
