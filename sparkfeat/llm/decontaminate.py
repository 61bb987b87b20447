"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to word sequences and read into one suffix automaton
over words (items are kept apart: no match runs from one into the next). Each
training text is streamed through it word by word, tracking the longest suffix of
the words so far that some item contains. Where that length reaches the window,
the last words are an item's words and are marked; items shorter than the window
count whole. Items are bounded in size per automaton; more items mean more
automata, one at a time: each is one pass over the texts whose marks are written by
text key, and the last pass unites them.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import materialize, slices, stowed, table

# Bytes that separate words: everything below "0", ":" to "`" and "{" to DEL, after folding A-Z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of word sequences; knows the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        prefixes = []                       # (item, state of each of its prefixes)
        for name, words in items:
            last, states = 0, []
            for word in words:
                last = self._extend(last, word)
                states.append(last)
            if states:
                prefixes.append((name, states))
        n = len(self.size)
        # names[s]: items that hold a window ending in state s; found for each item from its prefixes up.
        self.names: list[set | None] = [None] * n
        self.short: list[list] = [[] for _ in range(n)]
        for name, states in prefixes:
            if len(states) < window:
                self.short[states[-1]].append((len(states), name))
                continue
            for s in states[window - 1:]:
                while self.size[self.link[s]] >= window:
                    s = self.link[s]
                if self.names[s] is None:
                    self.names[s] = set()
                self.names[s].add(name)
        # dictionary[s]: nearest state from s up its links that ends a short item
        self.dictionary = [-1] * n
        for s in sorted(range(1, n), key=self.size.__getitem__):
            self.dictionary[s] = s if self.short[s] else self.dictionary[self.link[s]]

    def _extend(self, last, word):
        nxt, link, size = self.next, self.link, self.size
        have = nxt[last].get(word)
        if have is not None:
            if size[have] == size[last] + 1:
                return have
            return self._split(last, word, have)
        new = len(size)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p, word, q):
        nxt, link, size = self.next, self.link, self.size
        copy = len(size)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [first, past) ranges of words inside occurring windows, and their items."""
        nxt, link, size, window, dictionary = self.next, self.link, self.size, self.window, self.dictionary
        root = nxt[0]
        state = length = 0
        spans: list[list[int]] = []
        names: set = set()
        for i, word in enumerate(words):
            to = nxt[state].get(word)
            if to is not None:
                state = to
                length += 1
            elif word not in root:
                state = length = 0
                continue
            else:
                while word not in nxt[state]:
                    state = link[state]
                length = size[state] + 1
                state = nxt[state][word]
            reach = 0
            if length >= window:
                reach = length
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                if self.names[s]:
                    names |= self.names[s]
            s = dictionary[state]
            while s > 0:
                for n, name in self.short[s]:
                    if n <= length:
                        reach = max(reach, n)
                        names.add(name)
                s = dictionary[link[s]]
            if reach:
                first = i + 1 - reach
                while spans and first <= spans[-1][1]:
                    first = min(first, spans.pop()[0])
                spans.append([first, i + 1])
        return spans, names


def _merge(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_BUILT: dict = {}


def _automaton(shared, window):
    """Built once in each Python worker and broadcast."""
    key = (id(shared), window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (shared, ItemAutomaton([(n, normal_words(t)) for n, t in shared.value], window))
    return _BUILT[key][1]


HIT_TYPE = pa.struct([("spans", pa.list_(pa.list_(pa.int32()))), ("names", pa.list_(pa.string()))])


def _hits(auto, batch):
    """Per row: merged spans and item names of this automaton and those before it."""
    out = []
    for text, had in zip(batch.column("__text"), batch.column("__hits").to_pylist()):
        spans, names = auto.scan(normal_words(text.as_py()))
        if had:
            spans, names = _merge(spans + had["spans"]), names | set(had["names"])
        out.append({"spans": spans, "names": sorted(x for x in names if x is not None)})
    return out


def _found_of(shared, window):
    """The texts that this automaton hits, by their keys."""
    def run(batches):
        auto = _automaton(shared, window)
        for batch in slices(batches):
            rows = [(h0, h1, spans, sorted(x for x in names if x is not None))
                    for h0, h1, text in zip(*(batch.column(c) for c in ("__h0", "__h1", "__text")))
                    for spans, names in [auto.scan(normal_words(text.as_py()))] if spans]
            if rows:
                h0, h1, spans, names = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in h0], pa.int64()), pa.array([x.as_py() for x in h1], pa.int64()),
                                                  pa.array(spans, HIT_TYPE["spans"].type), pa.array(names, HIT_TYPE["names"].type)],
                                                 names=["__h0", "__h1", "spans", "names"])
    return run


def _cut_of(shared, window, min_span, max_coverage):
    """The last automaton's scan, and the results."""
    def run(batches):
        auto = _automaton(shared, window)
        for batch in slices(batches):
            out = []
            for text, hits in zip(batch.column("__text").to_pylist(), _hits(auto, batch)):
                raw = (text or "").encode()
                spans, names = hits["spans"], hits["names"]
                folded = raw.translate(_FOLD)
                n_words = len(folded.split())
                n_hit = sum(b - a for a, b in spans)
                cut = [s for s in spans if s[1] - s[0] >= min_span]
                clean = text
                if cut:
                    at = [m.span() for m in re.finditer(rb"[^ ]+", folded)]
                    parts, past = [], 0
                    for a, b in cut:
                        parts.append(raw[past:at[a][0]])
                        past = at[b - 1][1]
                    clean = b"".join([*parts, raw[past:]]).decode()
                out.append((n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(),
                            n_hit > 0, bool(n_words and n_hit / n_words > max_coverage), clean, spans))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            names = [c for c in batch.schema.names if c not in ("__text", "__hits")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=[*names, *OUT])
    return run


OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "over_coverage", "clean_text", "hit_spans"]
OUT_TYPES = ["long", "long", "long", "string", "boolean", "boolean", "string", "array<array<int>>"]


class item_shards:  # noqa: N801
    """The items in lists of at most ``max_bytes`` of text (one item at least), fetched one after the other.

    More items than one list holds are written to the shared folder by hash classes of
    half that size; going through the lists reads one class at a time, so the driver
    holds a class and a list, however many items there are. Repeated items count once.
    """

    def __init__(self, items: DataFrame, item_id: str, text: str, max_bytes: int):
        self.max_bytes = max_bytes
        self.items = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("t")).where("t is not null").distinct()
        size = self.items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.classes = max(1, -(-2 * size // max_bytes)) if size > max_bytes else 1
        if self.classes > 1:
            part = F.pmod(F.xxhash64("name", "t"), F.lit(self.classes)).alias("part")
            self.items = materialize(self.items.select("name", "t", part).repartitionByRange("part"), "items")

    def __iter__(self):
        for k in range(self.classes):
            part = self.items.where(F.col("part") == k) if self.classes > 1 else self.items
            held, n = [], 0
            for row in part.select("name", "t").toLocalIterator():
                if held and n + len(row.t.encode()) > self.max_bytes:
                    yield held
                    held, n = [], 0
                held.append((row.name, row.t))
                n += len(row.t.encode())
            if held:
                yield held


def _earlier_hits(texts: DataFrame, shards, window: int) -> tuple[DataFrame | None, list]:
    """Hits by text of all shards but the last, and the last shard.

    One shard at a time is sent out, scanned over all texts, its hits written, and
    freed. Copies of a text have equal hits, so one of them is kept in each shard.
    """
    spark, tables, last = texts.sparkSession, [], []
    for shard in shards:
        if last:
            shared = spark.sparkContext.broadcast(last)
            found = texts.mapInArrow(_found_of(shared, window), "__h0 long, __h1 long, spans array<array<int>>, names array<string>")
            tables.append(materialize(found.dropDuplicates(["__h0", "__h1"]), "hits"))
            shared.destroy()
        last = shard
    if not tables:
        return None, last
    return (reduce(DataFrame.unionAll, tables).groupBy("__h0", "__h1")
            .agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names")).alias("__hits"))), last


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, min_span: int = 10, max_coverage: float = 0.5,
                  shard_bytes: int = 1_500_000) -> DataFrame:
    """Mark the words of every text that lie inside an occurrence of an item's window.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. Words: A-Z folded, runs of digits, letters and
    non-ASCII characters. Returns the columns of ``docs`` without the text, then
    n_words, n_hit, n_items (different item ids), items_sha256 (ids sorted as
    strings, comma-joined), contaminated (n_hit > 0), over_coverage (share of hit
    words over ``max_coverage``), clean_text (hit spans of ``min_span`` words or
    more removed; null stays null), hit_spans. Null and empty texts have no words.
    Items with a null id mark words but are not counted; a repeated id counts
    once. No items: nothing is hit. One row per input row. Columns of ``docs``
    named like an output column, in any case, are replaced.
    """
    spark = docs.sparkSession
    keep, names = stowed(docs, (text, *OUT))
    work = docs.select(*keep, F.col(text).alias("__text"))
    keyed = work.select("*", *(F.xxhash64(F.lit(k), "__text").alias(f"__h{k}") for k in (0, 1)))
    earlier, last = _earlier_hits(keyed.select("__h0", "__h1", "__text").where("__text is not null"),
                                  item_shards(items, item_id, item_text, shard_bytes), window)
    if earlier is None:
        work = work.withColumn("__hits", F.lit(None).cast("struct<spans: array<array<int>>, names: array<string>>"))
    else:
        work = keyed.join(earlier, ["__h0", "__h1"], "left").drop("__h0", "__h1")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema if f.name not in ("__text", "__hits"))
    out = ", ".join(f"{n} {t}" for n, t in zip(OUT, OUT_TYPES))
    return work.mapInArrow(_cut_of(spark.sparkContext.broadcast(last), window, min_span, max_coverage), f"{kept}, {out}" if kept else out).toDF(*names, *OUT)


def op10_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), occ AS (
  SELECT doc_id, i, win.n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) g JOIN win ON g.n = win.n AND g.s = win.s
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, unnest(range(0, n)) AS u(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
