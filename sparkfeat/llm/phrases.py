"""Substring deduplication with repeated-phrase automata.

A window is ``window`` consecutive words of one document. Every word covered by
a window whose word sequence also starts anywhere else is removed.

Method
  1. One pass over all texts cuts each document into runs of windows that share
     their smallest 8-word hash (the anchor). Equal windows have equal anchors,
     so a window can recur only inside a run whose anchor recurs. A run is one
     short row: anchor, hash of the run's words and both neighbour words.
  2. Runs are counted by (anchor, hash). If all runs of a recurring anchor are
     equal, all their windows recur and always in this order. Otherwise the
     windows of one representative of each different run are counted by a
     128-bit hash: this confirms the recurring windows.
  3. Confirmed windows that always follow each other (same single neighbour on
     both sides everywhere) are chained to phrases, taken from one representative
     document. Each phrase occurs whole wherever any of its windows occurs.
     Adjacent phrases of about equal frequency travel as one passage with cuts,
     so overlapping phrases are not sent 35 words at a time.
  4. Documents are dealt to buckets by hash. A passage goes, once, to each bucket
     with a document that holds the rarest anchor of one of its phrases; the
     bucket's task compiles Aho-Corasick automata over its phrases (in shards of
     bounded size) and streams its documents through them. The automaton decides
     every occurrence word by word.

No row of a hot phrase meets in one task: counts combine before the shuffle and
the joins by anchor or passage are plain equi-joins between exchanges, which
adaptive execution splits. A row is known by two 64-bit hashes of document id and
text, ``uid`` and ``tag``, so different documents do not merge at any corpus size; a
representative place is checked against its run's hash before it is used, and
the automaton compares words.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import (U64, RangeHash, byte_blocks, drop_materialized, materialize,
                                  mix64, slices, sliding, table, word_hashes, word_spans)

GRAM = 8
SHARD_NODES = 3_000_000      # trie nodes of one automaton: bounds a task's memory
DIGITS = 64                  # most children of a trie node
BLOCK_CHARS = 12_000_000     # text of one bucket that is scanned at once
BUCKET_WINDOWS = 2_000_000   # windows of a bucket of documents on average


# ------------------------------------------------------------------ kernels

def _anchor_runs(buf, offs, window):
    """Runs of windows with one anchor: anchor, row, first window, last window."""
    starts, ends, rows = word_spans(buf, offs)
    n = len(starts)
    if n < window:
        return starts, ends, rows, None, None
    words = word_hashes(buf, starts, ends)
    rng = RangeHash(words)
    at = np.arange(n - GRAM + 1)
    smallest = sliding(np.minimum, rng(at, at + GRAM), window - GRAM + 1)
    ok = rows[:n - window + 1] == rows[window - 1:]
    change = np.ones(len(ok) + 1, bool)
    change[1:-1] = (smallest[1:] != smallest[:-1]) | (rows[1:n - window + 1] != rows[:n - window])
    change[1:-1] |= ok[1:] != ok[:-1]
    first = np.flatnonzero(change[:-1] & ok)
    last = np.flatnonzero(change[1:] & ok)
    return starts, ends, rows, (words, rng, smallest, ok), (smallest[first], rows[first], first, last)


def _neighbours(words, rows, first, past):
    """Hash of the word before ``first`` and at ``past``, fixed marks at a document's ends."""
    n = len(words)
    before, after = np.maximum(first - 1, 0), np.minimum(past, n - 1)
    left = np.where((first > 0) & (rows[before] == rows[first]), words[before], U64(1))
    right = np.where((past < n) & (rows[after] == rows[first]), words[after], U64(2))
    return left, right


def _self_repeating(rng, n, window, smallest, ok, runs):
    """Runs that hold their anchor at more than one place (a superset: by anchor value)."""
    width = window - GRAM + 1
    at = np.arange(n - GRAM + 1)
    grams = rng(at, at + GRAM)
    pad = np.zeros(width - 1, U64)
    best = sliding(np.maximum, np.concatenate([pad, np.where(ok, smallest, U64(0)), pad]), width)
    anchors = np.flatnonzero(best == grams)
    value = grams[anchors]
    near = (value[1:] == value[:-1]) & (np.diff(anchors) <= width)
    return np.isin(runs[0], value[1:][near])


def _longs(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _take(column, rows):
    return column.take(pa.array(rows.astype(np.int64)))


RUN_SCHEMA = "uid long, tag long, anchor long, body long, place long, twice boolean"


def _runs_of(window):
    def run(batches):
        for batch in slices(batches):
            for lo, hi, buf, offs in byte_blocks(batch.column("text")):
                _, _, rows, state, runs = _anchor_runs(buf, offs, window)
                if runs is None or not len(runs[0]):
                    continue
                words, rng, smallest, ok = state
                anchor, row, first, last = runs
                base = np.searchsorted(rows, np.arange(hi - lo))
                twice = _self_repeating(rng, len(words), window, smallest, ok, runs)
                yield pa.RecordBatch.from_arrays(
                    [_take(batch.column("uid"), row + lo), _take(batch.column("tag"), row + lo), _longs(anchor),
                     _longs(_body(words, rng, rows, first, last + window)),
                     pa.array(((first - base[row]) << 31) + last - first + 1), pa.array(twice)],
                    names=["uid", "tag", "anchor", "body", "place", "twice"])
    return run


def _body(words, rng, rows, first, past):
    left, right = _neighbours(words, rows, first, past)
    return mix64(rng(first, past) + left * U64(3) + right * U64(5))


SPAN_TYPE = pa.list_(pa.struct([("place", pa.int64()), ("weight", pa.int64()), ("uniform", pa.bool_()),
                                ("body", pa.int64()), ("total", pa.int64())]))


def _checked_of(window):
    """Keep the spans whose words and neighbours hash to their run."""
    def run(batches):
        for batch in slices(batches):
            spans, text = batch.column("spans"), batch.column("text")
            for lo, hi, buf, offs in byte_blocks(text):
                starts, ends, rows = word_spans(buf, offs)
                words = word_hashes(buf, starts, ends)
                rng = RangeHash(words)
                size = np.bincount(rows, minlength=hi - lo)
                base = np.cumsum(size) - size
                part = spans.slice(lo, hi - lo)
                flat, row = part.flatten(), np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                place = np.asarray(flat.field("place"))
                first, past = place >> 31, (place >> 31) + (place & 0x7FFFFFFF) + window - 1
                fits = past <= size[row]
                body = np.asarray(flat.field("body")).view(U64)
                good = np.zeros(len(place), bool)
                at, to = (first + base[row])[fits], (past + base[row])[fits]
                good[fits] = _body(words, rng, rows, at, to) == body[fits]
                kept = flat.filter(pa.array(good))
                edges = np.concatenate([[0], np.cumsum(np.bincount(row[good], minlength=hi - lo))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(lo, hi - lo), batch.column("tag").slice(lo, hi - lo), text.slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), kept).cast(SPAN_TYPE)],
                    names=["uid", "tag", "text", "spans"])
    return run


WINDOW_SCHEMA = ("uid long, tag long, w1 long, w2 long, left long, right long, "
                 "pos int, weight long")


def _windows_of(window):
    """Windows of the given representative runs, once per document with a weight."""
    def run(batches):
        for batch in slices(batches):
            spans = batch.column("spans")
            for lo, hi, buf, offs in byte_blocks(batch.column("text")):
                starts, ends, rows = word_spans(buf, offs)
                words = word_hashes(buf, starts, ends)
                base = np.searchsorted(rows, np.arange(hi - lo))
                first, count, weight = _span_columns(spans, lo, hi, base)
                if not len(first):
                    continue
                at = np.repeat(first, count) + _ramp(count)
                weight = np.repeat(weight, count)
                one, two = RangeHash(words)(at, at + window), RangeHash(mix64(words), 1)(at, at + window)
                left, right = _neighbours(words, rows, at, at + window)
                row = rows[at]
                yield pa.RecordBatch.from_arrays(
                    [_take(batch.column("uid"), row + lo), _take(batch.column("tag"), row + lo), _longs(one), _longs(two), _longs(left), _longs(right),
                     pa.array((at - base[row]).astype(np.int32)), pa.array(weight)],
                    names=["uid", "tag", "w1", "w2", "left", "right", "pos", "weight"])
    return run


def _ramp(count):
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)


def _span_columns(spans, lo, hi, base):
    """Flatten the spans of rows lo..hi to first word in the block, windows and weight."""
    part = spans.slice(lo, hi - lo)
    flat = part.flatten()
    size = np.asarray(part.value_lengths().fill_null(0))
    row = np.repeat(np.arange(hi - lo), size)
    place = np.asarray(flat.field("place"))
    return (place >> 31) + base[row], place & 0x7FFFFFFF, np.asarray(flat.field("weight"))


PASSAGE_SCHEMA = "anchors array<long>, passage binary, cuts array<int>"


def _passages_of(window):
    """Chain the confirmed windows and runs of a representative document to passages."""
    def run(batches):
        for batch in slices(batches):
            nodes = batch.column("nodes")
            for lo, hi, buf, offs in byte_blocks(batch.column("text")):
                starts, ends, rows, state, _ = _anchor_runs(buf, offs, window)
                if state is None:
                    continue
                base = np.searchsorted(rows, np.arange(hi - lo))
                part = nodes.slice(lo, hi - lo)
                flat = part.flatten()
                row = np.repeat(np.arange(hi - lo), np.asarray(part.value_lengths()))
                place = np.asarray(flat.field("place"))
                pos, count = (place >> 31) + base[row], place & 0x7FFFFFFF
                lefty, righty = (np.asarray(flat.field(c)).astype(bool) for c in ("one_left", "one_right"))
                total = np.asarray(flat.field("total")).astype(float)
                order = np.argsort(pos, kind="stable")
                pos, count, lefty, righty, row, total = (x[order] for x in (pos, count, lefty, righty, row, total))
                if not len(pos):
                    continue
                near = (pos[1:] == pos[:-1] + count[:-1]) & (row[1:] == row[:-1])
                link = near & righty[:-1] & lefty[1:]
                even = near & (total[1:] <= 2 * total[:-1]) & (total[:-1] <= 2 * total[1:])
                head = np.flatnonzero(np.concatenate([[True], ~link]))
                tail = np.append(head[1:], len(pos)) - 1
                first, past = pos[head], pos[tail] + count[tail] - 1 + window       # phrases
                new = np.concatenate([[True], ~(even | link)])[head]                # passages of phrases
                group = np.append(np.flatnonzero(new), len(head))
                # A phrase is known by the rarest anchor among its windows.
                span0, span_n, _ = _span_columns(batch.column("spans"), lo, hi, base)
                runs = np.asarray(batch.column("spans").slice(lo, hi - lo).flatten().field("total"))
                rarity = np.full(len(state[2]), np.iinfo(np.int64).max)
                rarity[np.repeat(span0, span_n) + _ramp(span_n)] = np.repeat(runs, span_n)
                rarest = np.array([a + int(np.argmin(rarity[a:b - window + 1])) for a, b in zip(first, past)])
                raw, anchor = buf.tobytes(), state[2][rarest].view(np.int64)
                text, cuts, anchors = [], [], []
                for a, b in zip(group[:-1], group[1:]):
                    text.append(b" ".join(raw[starts[first[a]]:ends[past[b - 1] - 1]].split()))
                    cuts.append(np.stack([first[a:b], past[a:b]], axis=1).ravel() - first[a])
                    anchors.append(np.unique(anchor[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.list_(pa.int64())), pa.array(text, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))],
                    names=["anchors", "passage", "cuts"])
    return run


def _shards(passages):
    """Code of each word in the passages, its length, and automata over the phrases cut from them.

    Words are numbered and the numbers written in base ``DIGITS``, every digit
    place with letters of its own: exact, aligned to words, and no trie node has
    more than ``DIGITS`` children (a node's children are searched one by one).
    """
    number: dict[bytes, int] = {}
    numbered = [([number.setdefault(w, len(number)) for w in passage.split(b" ")], cuts) for passage, cuts in passages]
    size = 1
    while DIGITS ** size < len(number):
        size += 1
    codes = ["".join(chr(1 + k * DIGITS + n // DIGITS ** k % DIGITS) for k in range(size)) for n in range(len(number))]
    phrases = {"".join([codes[n] for n in words[a:b]]): None
               for words, cuts in numbered for a, b in zip(cuts[::2], cuts[1::2])}

    def automata():
        auto, held = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        for phrase in phrases:
            if held and held + len(phrase) > SHARD_NODES:
                auto.make_automaton()
                yield auto
                auto, held = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
            auto.add_word(phrase, len(phrase) // size)
            held += len(phrase)
        if held:
            auto.make_automaton()
            yield auto
    return {w: codes[n] for w, n in number.items()}, size, automata


OUT_SCHEMA = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
              "removed_spans array<struct<first: int, past: int>>")


def _judge(docs, passages, with_text):
    """Locate all phrases in the texts of one block, shard by shard, and cut them out."""
    code, size, automata = _shards(passages)
    found: list[list] = [[] for _ in docs]
    if code:
        get, other = code.get, "\0" * size
        streams = ["".join([get(w, other) for w in (text or "").encode().split()]) for _, text in docs]
        for auto in automata():
            for spans, stream in zip(found, streams):
                for end, n in auto.iter(stream):
                    past = (end + 1) // size
                    spans.append((past - n, past))
    out = []
    for (doc_id, text), spans in zip(docs, found):
        words = (text or "").encode().split()
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        kept, at = [], 0
        for a, b in merged:
            kept += words[at:a]
            at = b
        kept += words[at:]
        line = b" ".join(kept)
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(line).hexdigest(),
                    line.decode() if with_text else None, [{"first": a, "past": b} for a, b in merged]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                      names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed_spans"])


def _apply_of(with_text):
    """Stream rows sorted by bucket, passages before documents."""
    def run(batches):
        bucket, passages, docs, held = None, [], [], 0
        for batch in slices(batches):
            for row in zip(*(batch.column(c) for c in ("bucket", "kind", "doc_id", "text", "passage", "cuts"))):
                here, kind, doc_id, text, passage, cuts = (x.as_py() for x in row)
                if here != bucket or held >= BLOCK_CHARS:
                    if docs:
                        yield _judge(docs, passages, with_text)
                    docs, held = [], 0
                    if here != bucket:
                        bucket, passages = here, []
                if kind == 0:
                    passages.append((passage, cuts))
                else:
                    docs.append((doc_id, text))
                    held += len(text or "")
        if docs:
            yield _judge(docs, passages, with_text)
    return run


# ------------------------------------------------------------------ operator

def _row_key():
    return F.xxhash64("doc_id", "text").alias("uid"), F.xxhash64(F.lit(1), "doc_id", "text").alias("tag")


def remove_repeated_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            window: int = 35, with_text: bool = True) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that starts more than once.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256,
    kept_text (kept words joined by one space; null unless ``with_text``) and the
    removed word ranges. Null and empty texts have no words and stay as rows;
    rows with a null doc_id are judged like any other; repeated rows (same id and
    text) repeat their windows, so they are removed; other columns of the input
    are ignored, whatever their names. An empty table gives no rows.
    """
    if window < GRAM + 1:
        raise ValueError(f"window must be over {GRAM} words")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", "text", *_row_key())

    runs = materialize(docs.select("uid", "tag", "text").mapInArrow(_runs_of(window), RUN_SCHEMA), "runs")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = runs.agg(F.sum(F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)))).first()[0] or 0
    buckets = max(parts, 1 + windows // BUCKET_WINDOWS)
    anchors = materialize(
        runs.groupBy("anchor").agg(F.count("*").alias("total"), F.max("twice").alias("twice"),
                                   F.min("body").alias("low"), F.max("body").alias("high"))
        .where("total > 1 or twice").select("anchor", "total", F.expr("low = high and not twice").alias("uniform")), "anchors")
    recurring = materialize(runs.join(anchors, "anchor").select("uid", "tag", "anchor", "body", "place", "uniform", "total"), "recurring")
    drop_materialized(runs)
    drop_materialized(anchors)

    # One representative place for each different run: the smallest uid, so that runs
    # (and windows below) that share their documents are taken from the same one.
    spans = (recurring.groupBy("anchor", "body").agg(
        F.count("*").alias("weight"), F.max("uniform").alias("uniform"), F.max("total").alias("total"),
        F.min("uid").alias("uid"), F.min_by("tag", "uid").alias("tag"), F.min_by("place", "uid").alias("place"))
        .groupBy("uid", "tag").agg(F.collect_list(F.struct("place", "weight", "uniform", "body", "total")).alias("spans")))
    # Repeated rows (same id, same text) are read for places once.
    holders = materialize(
        docs.select("uid", "tag", "text").join(spans, ["uid", "tag"]).dropDuplicates(["uid", "tag"])
        .mapInArrow(_checked_of(window), "uid long, tag long, text string, spans array<struct<place: long, weight: long, "
                    "uniform: boolean, body: long, total: long>>"), "holders")
    windows = (holders.select("uid", "tag", "text", F.filter("spans", lambda s: ~s["uniform"]).alias("spans"))
               .where(F.size("spans") > 0).mapInArrow(_windows_of(window), WINDOW_SCHEMA))
    confirmed = (windows.groupBy("w1", "w2").agg(
        F.sum("weight").alias("total"),
        (F.min("left") == F.max("left")).alias("one_left"),
        (F.min("right") == F.max("right")).alias("one_right"),
        F.min("uid").alias("uid"), F.min_by("tag", "uid").alias("tag"), F.min_by("pos", "uid").alias("pos"))
        .where("total > 1")
        .select("uid", "tag", F.struct((F.shiftleft(F.col("pos").cast("long"), 31) + 1).alias("place"),
                                "one_left", "one_right", "total").alias("node")))
    uniform = (holders.select("uid", "tag", F.explode(F.filter("spans", lambda s: s["uniform"])).alias("s"))
               .select("uid", "tag", F.struct("s.place", F.lit(True).alias("one_left"), F.lit(True).alias("one_right"),
                                       F.col("s.weight").alias("total")).alias("node")))
    nodes = confirmed.unionAll(uniform).groupBy("uid", "tag").agg(F.collect_list("node").alias("nodes"))
    passages = materialize(holders.join(nodes, ["uid", "tag"]).mapInArrow(_passages_of(window), PASSAGE_SCHEMA)
                           .withColumn("pid", F.monotonically_increasing_id()), "passages")
    drop_materialized(holders)

    # Buckets with a document that holds the rarest anchor of one of a passage's phrases.
    bucket = F.pmod("uid", F.lit(buckets)).cast("int").alias("bucket")
    pairs = (recurring.select(bucket, "anchor").distinct()
             .join(passages.select("pid", F.explode("anchors").alias("anchor")), "anchor")
             .select("bucket", "pid").distinct())
    sent = materialize(pairs.join(passages.select("pid", "passage", "cuts"), "pid").select("bucket", "passage", "cuts"), "sent")
    drop_materialized(recurring)
    drop_materialized(passages)
    rows = (sent.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"),
                        F.lit(None).cast("string").alias("text"), "passage", "cuts")
            .unionAll(docs.select(bucket, F.lit(1).alias("kind"), "doc_id", "text",
                                  F.lit(None).cast("binary").alias("passage"), F.lit(None).cast("array<int>").alias("cuts"))))
    return (rows.repartitionById(buckets, "bucket").sortWithinPartitions("kind")      # one bucket a task
            .mapInArrow(_apply_of(with_text), OUT_SCHEMA))


def op2_phrase_dedup(spark, sf_dir):
    return remove_repeated_phrases(table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), twice AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i FROM win SEMI JOIN twice ON win.s = twice.s), unnest(range(0, 35)) AS u(k)
), word AS (
  SELECT rid, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)
), kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS line FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
