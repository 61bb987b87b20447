"""Ranked lexical search with range-maximum tables over posting lists.

Documents are read once into shards: a shard holds some thousand documents, ordered by id,
and one posting list per term. For a query each list becomes impacts with a sparse table
that answers the largest impact of any interval of documents. The search holds intervals,
best bound first; an interval's bound is the weighted sum of its lists' largest impacts. The
best interval is split at the document with the largest weighted impact: that document is
scored exactly and the two intervals beside it get bounds of their own, until none reaches
the kth score. Queries are first searched in a part of the shards; the kth scores found
there bound the search in the others. Scores are whole numbers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, slices, table

SHARD = 8192              # documents of a shard, 65,536 at most
POSTINGS = 2_000_000      # a shard ends early beyond so many postings
ITEMS = 100               # queries searched together in a shard
FIRST = 8                 # one shard in so many is searched first
DENSE = 1 << 25           # cells of a table of list positions by document; beyond, binary search

# Bytes of terms: digits, letters (A-Z folded to a-z) and everything beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


# ------------------------------------------------------------------ index

INDEX = "shard long, term string, n long, words long, docs binary, tfs binary, ids array<long>, sizes binary"


class _Shard:
    """Posting lists of the documents read so far."""

    def __init__(self):
        self.vocabulary, self.terms, self.tfs, self.ids, self.distinct, self.sizes = {}, [], [], [], [], []

    def add(self, doc_id, words):
        counts = Counter(words)
        own = self.vocabulary
        self.terms.append(np.fromiter((own.setdefault(w, len(own)) for w in counts), np.int32, len(counts)))
        self.tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.distinct.append(len(counts))

    def rows(self, shard):
        """The documents' row (term null), then a row for each term; documents by rising id, those without one last."""
        order = sorted(range(len(self.ids)), key=lambda r: (self.ids[r] is None, self.ids[r] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield self._batch(shard, [None], [len(order)], [sum(self.sizes)], [None], [None], [[self.ids[r] for r in order]],
                          [np.array(self.sizes, "<i8")[order].tobytes()])
        doc, term = np.repeat(place, self.distinct), np.concatenate(self.terms)
        by = np.lexsort((doc, term))
        docs, tfs, term = doc[by].astype("<u2"), np.concatenate(self.tfs)[by].astype("<i4"), term[by]
        cuts = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        names = [w.decode() for w in self.vocabulary]
        for lo in range(0, len(names), 4096):
            own = range(lo, min(lo + 4096, len(names)))
            yield self._batch(shard, [names[t] for t in own], np.diff(cuts[lo:own[-1] + 2]).tolist(), [None] * len(own),
                              [docs[cuts[t]:cuts[t + 1]].tobytes() for t in own], [tfs[cuts[t]:cuts[t + 1]].tobytes() for t in own],
                              [None] * len(own), [None] * len(own))

    @staticmethod
    def _batch(shard, *columns):
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([shard] * len(columns[0]), pa.int64()), *map(pa.array, columns, types)],
                                          names=[c.split()[0] for c in INDEX.split(", ")])


def _index_of(shard_docs, postings):
    def run(batches):
        shard, held, piece, part = _Shard(), 0, 0, 0
        for batch in slices(batches, 256):
            for doc_id, text, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part"))):
                words, part = terms_of(text), p
                if not words:
                    continue
                shard.add(doc_id, words)
                held += shard.distinct[-1]
                if len(shard.ids) >= shard_docs or held >= postings:
                    yield from shard.rows((part << 32) + piece)
                    shard, held, piece = _Shard(), 0, piece + 1
        if shard.ids:
            yield from shard.rows((part << 32) + piece)
    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                shard: int = SHARD, postings: int = POSTINGS) -> DataFrame:
    """Posting lists of all documents, by shard and term, as a written table.

    A row without a term describes its shard's documents. Texts without a term (null and
    empty ones too) are in no shard. Repeated rows and ids count each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.spark_partition_id().cast("long").alias("part"))
    return materialize(rows.mapInArrow(_index_of(min(shard, 1 << 16), postings), INDEX), "index")


# ------------------------------------------------------------------ search of one query in one shard

class Lists:
    """Impacts of a query's posting lists, with one sparse table of range maxima over all lists.

    A table entry is impact * 2**16 + (65535 - document): the larger impact, and of equal ones
    the smaller document, is the larger number.
    """

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray], weights: list[int], n_docs: int):
        self.n = n_docs
        self.weights = np.array(weights, np.int64)
        sizes = [len(d) for d in docs]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        doc = np.concatenate(docs).astype(np.int64)
        self.impact = np.append(np.concatenate(impacts), 0)        # one past the end: read, never counted
        table = [(self.impact[:-1] << 16) + (65535 - doc)]
        width = 1
        while 2 * width <= max(sizes):
            above = table[-1].copy()
            above[:-width] = np.maximum(above[:-width], above[width:])
            table.append(above)
            width *= 2
        self.table = np.concatenate(table)
        self.span = len(doc)
        self.level = np.zeros(max(sizes) + 1, np.int64)
        self.level[1:] = np.log2(np.arange(1, max(sizes) + 1)).astype(np.int64)
        list_no = np.repeat(np.arange(len(docs)), sizes)
        if len(docs) * (n_docs + 1) <= DENSE:
            seen = np.zeros((n_docs + 1, len(docs)), np.int32)
            seen[doc + 1, list_no] = 1
            self.seen, self.keys = np.cumsum(seen, axis=0, dtype=np.int32), None
        else:
            self.seen, self.keys = None, list_no * (n_docs + 1) + doc

    def before(self, d: np.ndarray) -> np.ndarray:
        """Position in the whole of each list's first posting at or after the documents: (documents, lists)."""
        if self.seen is not None:
            return self.seen[d] + self.offsets
        return np.searchsorted(self.keys, d[:, None] + np.arange(len(self.weights)) * (self.n + 1))

    def bounds(self, a: np.ndarray, b: np.ndarray):
        """Bound of the score inside intervals given by list positions, and the document to split at."""
        length = b - a
        level = self.level[length]
        top = np.maximum(self.table[np.minimum(level * self.span + a, len(self.table) - 1)],
                         self.table[np.maximum(level * self.span + b - (1 << level), 0)])
        part = np.where(length > 0, (top >> 16) * self.weights, 0)
        best = part.argmax(1)
        return part.sum(1), 65535 - (top[np.arange(len(top)), best] & 65535)

    def scores(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        return (np.where(after > at, self.impact[at], 0) * self.weights).sum(1)


def best_documents(lists: Lists, k: int, floor: int = 1, log: list | None = None):
    """(documents, scores) of the k best, scores at least ``floor`` (above 0), ties to the smaller document."""
    lo, hi = np.array([0]), np.array([lists.n])
    bound, split = lists.bounds(lists.before(lo), lists.before(hi))
    docs, scores, visited, batch = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 16
    kth, last = max(floor, 1), lists.n
    while True:
        keep = (bound > kth) | ((bound == kth) & (lo < last))
        lo, hi, bound, split = lo[keep], hi[keep], bound[keep], split[keep]
        if not len(lo):
            break
        batch = min(2 * batch, max(32, (1 << 18) // len(lists.weights)))
        if len(lo) > batch:                                # best bounds first
            turn = np.argpartition(-bound, batch)
            now, rest = turn[:batch], turn[batch:]
        else:
            now, rest = np.arange(len(lo)), np.zeros(0, np.int64)
        left, right, at = lo[now], hi[now], split[now]
        here, after = lists.before(at), lists.before(at + 1)
        docs = np.concatenate([docs, at])
        scores = np.concatenate([scores, lists.scores(here, after)])
        visited += len(at)
        by = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[by], scores[by]
        if len(docs) == k and scores[-1] >= kth:
            kth, last = int(scores[-1]), int(docs[-1])
        first, past = left < at, at + 1 < right            # the intervals beside the document
        new_lo, new_hi = np.concatenate([left[first], at[past] + 1]), np.concatenate([at[first], right[past]])
        a = np.concatenate([lists.before(left[first]), after[past]])
        b = np.concatenate([here[first], lists.before(right[past])])
        new_bound, new_split = lists.bounds(a, b)
        lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
        bound, split = np.concatenate([bound[rest], new_bound]), np.concatenate([split[rest], new_split])
    if log is not None:
        log.append(visited)
    good = scores >= max(floor, 1)
    return docs[good], scores[good]


# ------------------------------------------------------------------ operator

FOUND = "q long, doc_id long, score long"


def _search_of(k, n_docs, n_terms):
    """One shard's posting lists for a block of queries, and the block's queries with the shard's documents."""
    def run(lists, heads):
        found = {"q": [], "doc_id": [], "score": []}
        posts = {t: (d, f) for t, d, f in zip(*(lists.column(c).to_pylist() for c in ("term", "docs", "tfs")))}
        for head in heads.to_pylist():
            sizes = np.frombuffer(head["sizes"], "<i8")
            # 25 n N may pass 64 bits for huge corpora: whole numbers without a bound
            m = np.array([75 + 25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)
            ready = {}
            for item in head["items"]:
                own = [(t["term"], t["weight"]) for t in item["terms"] if t["term"] in posts]
                if not own:
                    continue
                for term, _ in own:
                    if term not in ready:
                        doc, tf = np.frombuffer(posts[term][0], "<u2"), np.frombuffer(posts[term][1], "<i4").astype(np.int64)
                        ready[term] = doc, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                at, score = best_documents(Lists([ready[t][0] for t, _ in own], [ready[t][1] for t, _ in own],
                                                 [w for _, w in own], len(sizes)), k, item["floor"])
                found["q"] += [item["q"]] * len(at)
                found["doc_id"] += [head["ids"][d] for d in at.tolist()]
                found["score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in found.items()})
    return run


def _counts(batches):
    for batch in slices(batches):
        rows = [(q, t.decode(), c) for q, text in zip(*(batch.column(c).to_pylist() for c in ("q", "text")))
                for t, c in Counter(terms_of(text)).items()]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))],
                                         names=["q", "term", "count"])


def _search(index, wanted, items, k, n_docs, n_terms):
    """Best ``k`` documents of every item in every shard of ``index``."""
    lists = (index.where("term IS NOT NULL").select("shard", "term", "docs", "tfs")
             .join(wanted.select("block", "term").distinct(), "term"))
    pairs = lists.select("block", "shard").distinct()
    heads = (pairs.join(index.where("term IS NULL").select("shard", "ids", "sizes"), "shard")
             .join(items.groupBy("block").agg(F.collect_list(F.struct("q", "terms", "floor")).alias("items")), "block")
             .select(F.col("block").alias("of_block"), F.col("shard").alias("of_shard"), "ids", "sizes", "items"))
    return (lists.groupBy("block", "shard").cogroup(heads.groupBy("of_block", "of_shard"))
            .applyInArrow(_search_of(k, n_docs, n_terms), FOUND))


def _best(found, k):
    by = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", shard: int = SHARD,
                  postings: int = POSTINGS, block: int = ITEMS, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` best documents with a score above 0, fewer if there are fewer.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII in
    whole texts; null and empty texts have none. Every query row is a query of its own, also
    with a repeated or null item_id, and every document row a document: repeated rows rank
    each. Equal scores go by rising doc_id, documents without one last. A query without a term
    that some document holds has no rows; without documents there are none. Other columns are
    ignored.

    The index covers all documents; posting lists meet the queries' terms by an equal join and
    are grouped by shard and block of ``block`` queries.
    """
    index = build_index(docs, doc_id, text, shard, postings)
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(1))).first()
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item_id"),
                                       F.col(item_text).cast("string").alias("text")), "asked")
    words = asked.select("q", "text").mapInArrow(_counts, "q long, term string, count long")
    df = (index.where("term IS NOT NULL").select("term", "n").join(words.select("term").distinct(), "term")
          .groupBy("term").agg(F.sum("n").alias("df")))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    blocks = max(1, -(-asked.count() // block))
    items = materialize(words.join(df, "term").withColumn("weight", weight.cast("long") * F.col("count")).where("weight > 0")
                        .groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
                        .select("q", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "terms",
                                F.lit(1).cast("long").alias("floor")), "items")
    wanted = items.select("block", F.explode("terms.term").alias("term"))

    early = F.pmod(F.xxhash64("shard"), F.lit(first)) == 0
    head = materialize(_search(index.where(early), wanted, items, k, n_docs, n_terms), "head")
    floors = _best(head, k).where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    raised = items.join(floors, "q", "left").select("q", "block", "terms", F.coalesce("kth", "floor").alias("floor"))
    rest = materialize(_search(index.where(~early), wanted, raised, k, n_docs, n_terms), "rest")
    drop_materialized(index)
    return _best(head.unionAll(rest), k).join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op13_rmq_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL),
i AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE t IN (SELECT t FROM i) GROUP BY t),
r AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN f USING (t) JOIN p USING (t), s GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0
) WHERE rank <= 20
"""
