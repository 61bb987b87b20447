"""Document fingerprints: threshold-scaled sketches.

A text's words (A-Z lower-cased) give shingles of five; a shingle's hash is the first 64
bits of its MD5. The fingerprint keeps every distinct hash below a fixed fraction of the
hash range, so its size grows with the text and texts of very different lengths stay
comparable: the share of the smaller fingerprint's hashes that the larger one holds
estimates how much of the smaller text the larger one contains. A text none of whose
hashes is below the limit keeps its smallest. Fingerprints merge: the one of a union of
texts follows from theirs alone.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, slices, table

SHINGLE = 5
SHARE = 1 / 8         # fraction of all hashes that a fingerprint keeps
LANE_ROWS = 1000      # rows of one doc_id that stay together
HEX = 16              # hex digits of a hash


def limit_of(share: float) -> bytes:
    """First hash that is not kept, as bytes that compare like the number."""
    return min(int(share * 2 ** 64), 2 ** 64 - 1).to_bytes(8, "big")


def sketch(text: str, shingle: int = SHINGLE, limit: bytes = limit_of(SHARE)) -> frozenset[bytes]:
    """Kept hashes of a text: none for a text without words; fewer than ``shingle`` words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return frozenset()
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    md5 = hashlib.md5
    kept, least = set(), None
    for a, b in zip(starts, ends[shingle - 1:] or ends[-1:]):
        h = md5(joined[a:b]).digest()[:8]
        if h < limit:
            kept.add(h)
        elif not kept and (least is None or h < least):
            least = h
    return frozenset(kept) if kept else frozenset((least,))


def written(marks) -> str:
    """A fingerprint as a string: its hashes in rising order, 16 hex digits each."""
    return b"".join(sorted(marks)).hex()


def likeness(a, b) -> float:
    """Share of the smaller fingerprint that the larger one holds; both empty: 1, one empty: 0."""
    if not a or not b:
        return float(len(a) == len(b))
    return len(a & b) / min(len(a), len(b))


def hashes_of(fingerprint: Column) -> Column:
    """A fingerprint column as an array of its hashes."""
    return F.filter(F.split(fingerprint, f"(?<=\\G.{{{HEX}}})"), lambda h: h != "")


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns."""
    x, y = hashes_of(a), hashes_of(b)
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(
        F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(doc_id, fingerprint), one row per input row; a null text reads as empty (fingerprint "")."""
    limit = limit_of(share)

    def run(batches):
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([written(sketch(t or "", shingle, limit)) for t in batch.column("text").to_pylist()], pa.string())],
                names=["doc_id", "fingerprint"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def merge_fingerprints(marks: DataFrame, group: str, fingerprint: str = "fingerprint", share: float = SHARE) -> DataFrame:
    """(group, fingerprint): the fingerprint of each group's texts taken together, from their fingerprints alone.

    Hashes are made distinct before they meet, so a group with a third of all rows is
    spread like any other; a group of empty fingerprints has an empty one.
    """
    limit = limit_of(share).hex()
    one = marks.select(F.col(group).alias("g"), F.explode_outer(hashes_of(F.col(fingerprint))).alias("h")).distinct()
    kept = (one.groupBy("g").agg(F.min("h").alias("least"),
                                 F.array_sort(F.collect_list(F.when(F.col("h") < limit, F.col("h")))).alias("low")))
    return kept.select(F.col("g").alias(group), F.when(F.size("low") > 0, F.array_join("low", ""))
                       .otherwise(F.coalesce("least", F.lit(""))).alias("fingerprint"))


# ------------------------------------------------------------------ a document and the next one

def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value (binary search)."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << s) for s in range(len(bounds).bit_length() - 1, -1, -1)])

    def step(at, width):
        to = at + width
        return F.when((to <= len(bounds)) & (F.get(held, to - 1) <= value), to).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _answers(shingle: int, limit: bytes, own_next: bool):
    """Rows in order of doc_id, after the row of the document before the first, to result rows.

    The document before, by rising doc_id, is the next one by descending doc_id. Only it and
    the current one are held.
    """
    def answer(doc_id, text, marks, after):
        after_text, after_marks = after
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after_text[:cut]
        edited_marks = marks if edited == text else sketch(edited, shingle, limit)
        return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(marks), written(edited_marks),
                likeness(marks, edited_marks), likeness(marks, after_marks))

    def run(batches):
        lane = here = before = current = None
        for batch in slices(batches, 256):
            out = []
            for row in batch.to_pylist():
                text = row["text"] or ""
                marks = sketch(text, shingle, limit)
                if own_next:
                    out.append(answer(row["doc_id"], text, marks, (text, marks)))
                    continue
                if (row["lane_id"], row["lane"]) != lane:
                    lane, here, before = (row["lane_id"], row["lane"]), None, None
                if (row["inside"], row["doc_id"]) != here:     # a new id: its first row stands for it
                    here, before, current = (row["inside"], row["doc_id"]), current if here else None, (text, marks)
                if not row["copied"]:
                    out.append(answer(row["doc_id"], text, marks, before))
            cols = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                       pa.float64(), pa.float64()))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return run


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    share: float = SHARE, lane_rows: int = LANE_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per input row.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as
    many first ones (or all) of the next document, by descending doc_id, after the last the
    first. Null and empty texts are empty documents. Rows that share a doc_id have the same
    next document, the one with the next smaller id; where that id is repeated, its smallest
    text stands for it. A row without a doc_id is its own next document. One document alone
    is its own next. An empty table gives no rows; other columns are ignored.

    The texts are shuffled once, by range of doc_id, and read in order; the first row of a
    range comes with a copy of the document before it. Rows of a doc_id with more than
    ``lane_rows`` rows are dealt to lanes of their own, each with such a copy.
    """
    spark, limit = docs.sparkSession, limit_of(share)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = rows.where("doc_id IS NOT NULL")
    ids = materialize(placed.groupBy("doc_id").count(), "ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts).alias("c")).first()[0] if parts > 1 else None
    bounds = sorted(set(cuts or []))
    ids = ids.withColumn("part", _position(F.col("doc_id"), bounds))

    # One row per range: its first id, and the last id of the range before (before the first: the last of all).
    ends = sorted(tuple(r) for r in ids.groupBy("part").agg(F.min("doc_id"), F.max("doc_id")).collect())
    before = spark.createDataFrame([(p, ends[k - 1][2]) for k, (p, _, _) in enumerate(ends)], "part int, far long")
    hot = materialize(ids.withColumn("near", F.lag("doc_id").over(W.partitionBy("part").orderBy("doc_id")))
                      .where(F.col("count") > lane_rows).join(before, "part")
                      .select("doc_id", "part", F.coalesce("near", "far").alias("source"),
                              F.ceil(F.col("count") / lane_rows).cast("int").alias("lanes")), "hot")
    lane_part = F.pmod(F.xxhash64("lane_id", "lane"), F.lit(parts)).cast("int").alias("part")
    wanted = materialize(
        before.select(F.col("far").alias("doc_id"), "part", F.lit(0).cast("long").alias("lane_id"), F.lit(0).alias("lane"), F.lit(0).alias("inside"))
        .unionAll(hot.select("doc_id", "part", F.lit(0).cast("long"), F.lit(0), F.lit(1)))
        .unionAll(hot.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("lane_id"),
                             F.explode(F.sequence(F.lit(1), "lanes")).alias("lane"))
                  .select("doc_id", lane_part, "lane_id", "lane", F.lit(0))), "wanted")
    stands = (placed.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
              .groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    copies = wanted.join(stands, "doc_id").select("part", "lane_id", "lane", "inside", "doc_id", F.lit(1).alias("copied"), "text")
    lane = F.when(F.col("lanes").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.col("lanes"))).cast("int")
    dealt = (placed.join(hot.select("doc_id", "lanes"), "doc_id", "left").withColumn("lane", lane)
             .withColumn("lane_id", F.when(F.col("lane") > 0, F.col("doc_id")).otherwise(F.lit(0).cast("long")))
             .select(F.when(F.col("lane") > 0, F.pmod(F.xxhash64("lane_id", "lane"), F.lit(parts)).cast("int"))
                     .otherwise(_position(F.col("doc_id"), bounds)).alias("part"),
                     "lane_id", "lane", F.lit(1).alias("inside"), "doc_id", F.lit(0).alias("copied"), F.coalesce("text", F.lit("")).alias("text")))
    ordered = (dealt.unionAll(copies).repartitionById(parts, "part")
               .sortWithinPartitions("lane_id", "lane", "inside", "doc_id", F.desc("copied"), "text"))
    answers = ordered.mapInArrow(_answers(shingle, limit, False), SCHEMA)
    alone = rows.where("doc_id IS NULL").mapInArrow(_answers(shingle, limit, True), SCHEMA)
    drop_materialized(ids)
    return answers.unionAll(alone)


def op11_scaled_sketch(spark, sf_dir):
    return edited_likeness(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, left(t, length(t) - length(t) // 3) || left(nt, length(t) // 3) AS et FROM n),
x AS (SELECT doc_id, 'own' AS kind, t AS s FROM e UNION ALL SELECT doc_id, 'edited', et FROM e UNION ALL SELECT doc_id, 'next', nt FROM e),
w AS (SELECT doc_id, kind, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS w FROM x),
h AS (SELECT doc_id, kind, list_distinct([left(md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')), {HEX})
                                          FOR i IN range(1, greatest(len(w) - {SHINGLE - 2}, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))]) AS h FROM w),
k AS (SELECT doc_id, kind, list_sort(CASE WHEN len(h) = 0 THEN h WHEN list_min(h) < '{limit_of(SHARE).hex()}'
             THEN [v FOR v IN h IF v < '{limit_of(SHARE).hex()}'] ELSE [list_min(h)] END) AS m FROM h)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.et) AS edited_sha256,
       array_to_string(o.m, '') AS fingerprint, array_to_string(c.m, '') AS edited_fingerprint,
       CASE WHEN len(o.m) = 0 OR len(c.m) = 0 THEN (len(o.m) = len(c.m))::INT::DOUBLE
            ELSE len(list_intersect(o.m, c.m))::DOUBLE / least(len(o.m), len(c.m)) END AS near_edited,
       CASE WHEN len(o.m) = 0 OR len(x.m) = 0 THEN (len(o.m) = len(x.m))::INT::DOUBLE
            ELSE len(list_intersect(o.m, x.m))::DOUBLE / least(len(o.m), len(x.m)) END AS near_next
FROM e JOIN k o ON o.doc_id = e.doc_id AND o.kind = 'own'
       JOIN k c ON c.doc_id = e.doc_id AND c.kind = 'edited'
       JOIN k x ON x.doc_id = e.doc_id AND x.kind = 'next'
"""
