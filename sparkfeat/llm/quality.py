"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over quantile bins and chosen feature pairs have
small two-dimensional tables. Training visits the tables in turn; each visit fits
one shallow tree on a histogram of the current gradients and adds a small step to
the table. Scoring adds up table entries, so it is a handful of vectorised array
reads per document, and each table shows what the model does with a feature.

The model is trained on a bounded sample of labelled documents (``max_train``);
features and scores are computed for all documents over whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import byte_blocks, mix64, slices, stowed, table, word_hashes, word_spans

FEATURES = ["log_words", "word_length", "word_length_spread", "upper", "digit", "symbol", "stop_mark",
            "other_mark", "non_ascii", "white", "newline", "upper_words", "capital_words", "symbol_tail",
            "one_byte_words", "long_words", "mark_only_words", "distinct_words", "top_repeat",
            "repeated_pairs", "repeated_fives", "byte_entropy", "words_per_line", "repeated_lines"]


# ------------------------------------------------------------------ features

_CLASS = np.zeros((8, 256), np.float32)
_CLASS[0, 65:91] = 1                                             # A-Z
_CLASS[1, 48:58] = 1                                             # digits
_CLASS[2, list(b"#$%&*+<=>@^_`|~\\{}[]/")] = 1                     # symbols
_CLASS[3, list(b".?!")] = 1                                      # sentence ends
_CLASS[4, list(b",;:'\"()-")] = 1                                # other marks
_CLASS[5, 128:] = 1                                              # bytes of non-ASCII characters
_CLASS[6, [9, 11, 12, 13, 32]] = 1
_CLASS[7, 10] = 1


def _per_row(values, edges):
    """Sums of ``values`` between consecutive ``edges``."""
    sums = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def _repeats(rows, keys, n):
    """Share of values of each row that are not their row's first, and the top value's share."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(r)))
    total = np.bincount(rows, minlength=n)
    kinds = np.bincount(r[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, r[first], runs)
    total1 = np.maximum(total, 1)
    return np.where(total > 0, 1 - kinds / total1, 0.0), top / total1


def block_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text of a block; all are defined for empty texts."""
    n = len(offs) - 1
    size = np.diff(offs)
    size1 = np.maximum(size, 1)
    starts, ends, rows = word_spans(buf, offs)
    count = np.bincount(rows, minlength=n)
    count1 = np.maximum(count, 1)
    edges = np.concatenate([[0], np.cumsum(count)])
    length = (ends - starts).astype(np.float64)
    mean = _per_row(length, edges) / count1
    spread = np.sqrt(np.maximum(_per_row(length ** 2, edges) / count1 - mean ** 2, 0))
    klass = [_per_row(_CLASS[c][buf], offs) / size1 for c in range(8)]
    histogram = np.zeros((n, 256))
    np.add.at(histogram, (np.repeat(np.arange(n), size), buf), 1)
    p = histogram / size1[:, None]
    # Logarithms may differ in the last bit with the place in an array: round, so that a
    # text's features (and with them the model) never depend on its neighbours.
    entropy = np.round(-(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1), 6)
    upper = np.concatenate([[0], np.cumsum(_CLASS[0][buf], dtype=np.int64)])
    mark = np.concatenate([[0], np.cumsum((_CLASS[2] + _CLASS[3] + _CLASS[4])[buf], dtype=np.int64)])
    n_upper, n_mark = upper[ends] - upper[starts], mark[ends] - mark[starts]
    if len(starts):
        tail = _CLASS[2][buf[ends - 1]] + (buf[ends - 1] == 33)
        head = _CLASS[0][buf[starts]]
    else:
        tail = head = np.zeros(0)
    share = lambda x: _per_row(x, edges) / count1
    words = word_hashes(buf, starts, ends)
    repeat, top = _repeats(rows, words, n)

    def grams(k):
        if len(words) < k:
            return np.zeros(n)
        own = rows[:len(rows) - k + 1] == rows[k - 1:]
        value = words[:len(words) - k + 1].copy()
        for j in range(1, k):
            value = mix64(value) + words[j:len(words) - k + 1 + j]
        return _repeats(rows[:len(rows) - k + 1][own], value[own], n)[0]

    breaks = np.flatnonzero(buf == 10)
    lines = np.bincount(np.searchsorted(offs, breaks, side="right") - 1, minlength=n) + 1
    line_start = np.unique(np.concatenate([breaks + 1, offs[:-1]]))
    line_row = np.searchsorted(offs, line_start, side="right") - 1
    inside = line_row < n
    line_start, line_row = line_start[inside], line_row[inside]
    line_end = np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)]
    line_end = np.minimum(line_end, offs[line_row + 1])
    some = line_end - line_start >= 8
    line_start, line_end, line_row = line_start[some], line_end[some], line_row[some]
    same_line = _repeats(line_row, word_hashes(buf, line_start, line_end), n)[0] if len(line_row) else np.zeros(n)
    cols = [np.round(np.log1p(count), 6), mean, spread, *klass,
            share((n_upper >= 0.6 * length) & (length > 1)), share(head), share(tail), share(length <= 1), share(length >= 15),
            share(n_mark == length), 1 - repeat, top, grams(2), grams(5), entropy, count / lines, same_line]
    return np.stack(cols, axis=1).astype(np.float64)


# ------------------------------------------------------------------ model

class AdditiveModel:
    """Additive lookup tables: ``tables[f][bin]`` and ``pairs[(f, g)][bin, bin]``."""

    def __init__(self, intercept, cuts, tables, coarse, pairs):
        self.intercept, self.cuts, self.tables, self.coarse, self.pairs = intercept, cuts, tables, coarse, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        small = {}
        for f, (cut, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cut, x[:, f], side="right")]
        for f in {f for pair in self.pairs for f in pair}:
            small[f] = np.searchsorted(self.coarse[f], x[:, f], side="right")
        for (f, g), values in self.pairs.items():
            total += values[small[f], small[g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x, bins):
    q = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[q > x.min()] if len(q) else q


def _leaf(g, h, l2=1.0):
    return g / (h + l2)


def _split(g, h, n, least):
    """Best cut of a histogram and its gain (second-order, ridge 1)."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    tg, th, tn = g.sum(), h.sum(), n.sum()
    if not len(cg):
        return -1, 0.0
    gain = cg ** 2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg ** 2 / (th + 1)
    gain[(cn < least) | (tn - cn < least)] = -1
    k = int(np.argmax(gain))
    return (k, gain[k]) if gain[k] > 1e-9 else (-1, 0.0)


def _tree(g, h, n, least, depth):
    """Step for each bin from a tree of ``depth`` levels on the histogram."""
    k, _ = _split(g, h, n, least) if depth else (-1, 0)
    if k < 0:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:k + 1], h[:k + 1], n[:k + 1], least, depth - 1),
                           _tree(g[k + 1:], h[k + 1:], n[k + 1:], least, depth - 1)])


def _tree2(g, h, n, least):
    """Step for each cell from a cut along one axis and one cut of each half along the other."""
    best, step, score = None, None, 0.0
    for axis in (0, 1):
        a, b, c = (x if axis == 0 else x.T for x in (g, h, n))
        for k in range(a.shape[0] - 1):
            out, total = np.empty_like(a), 0.0
            for part in (slice(0, k + 1), slice(k + 1, None)):
                pg, ph, pn = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                if pn.sum() < least:
                    total = -1.0
                    break
                cut, gain = _split(pg, ph, pn, least)
                total += pg.sum() ** 2 / (ph.sum() + 1) + gain
                row = _tree(pg, ph, pn, least, 1) if cut >= 0 else np.full(len(pg), _leaf(pg.sum(), ph.sum()))
                out[part] = row
            if total > score:
                best, step, score = axis, out, total
    if best is None:
        return np.full(g.shape, _leaf(g.sum(), h.sum())), 0.0
    return (step if best == 0 else step.T), score


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8,
        bins: int = 64, coarse: int = 8, rate: float = 0.15, least: int = 5) -> AdditiveModel:
    """Cyclic boosting: all single tables in turn, then the pairs of largest gain."""
    n_rows, width = x.shape if len(x) else (0, len(FEATURES))
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(rate0 / (1 - rate0)))
    cuts = [_cuts(x[:, f], bins) if n_rows else np.zeros(0) for f in range(width)]
    wide = [_cuts(x[:, f], coarse) if n_rows else np.zeros(0) for f in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if n_rows == 0 or y.min() == y.max():
        return AdditiveModel(intercept, cuts, tables, wide, {})
    at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(width)]
    size = [np.bincount(a, minlength=len(t)) for a, t in zip(at, tables)]
    total = np.full(n_rows, intercept)
    p = 1 / (1 + np.exp(-total))
    for _ in range(rounds):
        for f in range(width):
            m = len(tables[f])
            g, h = np.bincount(at[f], y - p, m), np.bincount(at[f], p * (1 - p), m)
            step = rate * np.clip(_tree(g, h, size[f], least, 2), -4, 4)
            tables[f] += step
            total += step[at[f]]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    small = [np.searchsorted(wide[f], x[:, f], side="right") for f in range(width)]

    def cells(f, g):
        shape = (len(wide[f]) + 1, len(wide[g]) + 1)
        key = small[f] * shape[1] + small[g]
        hist = lambda w: np.bincount(key, w, shape[0] * shape[1]).reshape(shape)
        return key, hist(y - p), hist(p * (1 - p)), hist(np.ones(n_rows))

    gains = sorted(((-_tree2(*cells(f, g)[1:], least)[1], f, g) for f in range(width) for g in range(f)), key=lambda t: t)
    pairs = {(f, g): np.zeros((len(wide[f]) + 1, len(wide[g]) + 1)) for _, f, g in gains[:n_pairs]}
    for _ in range(pair_rounds):
        for (f, g), values in pairs.items():
            key, hg, hh, hn = cells(f, g)
            step = rate * np.clip(_tree2(hg, hh, hn, least)[0], -4, 4)
            values += step
            total += step.ravel()[key]
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return AdditiveModel(intercept, cuts, tables, wide, pairs)


# ------------------------------------------------------------------ operator

def _features_of(batches):
    for batch in slices(batches):
        for lo, hi, buf, offs in byte_blocks(batch.column("text")):
            x = block_features(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo),
                 pa.array(list(x), pa.list_(pa.float64()))], names=["__id", "label", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  label: str = "quality", max_train: int = 20_000, seed: int = 17) -> AdditiveModel:
    """Fit on at most ``max_train`` labelled documents outside the held-out quarter.

    The sample is the smallest seeded hashes of labelled ids, so it does not
    depend on the partitioning. An id labelled both ways counts as label 0;
    null ids and null labels are left out; of documents that share an id one row
    counts (the smallest features), so the rows stay within ``max_train``. Without labels, or with one label
    only, the model is the base rate.
    """
    ids = (labels.select(F.col(doc_id).cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
           .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("__id")))
           .groupBy("__id").agg(F.min("label").alias("label"))
           .orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(max_train))
    texts = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    # At most max_train rows of two numbers: the broadcast size is bounded.
    rows = (texts.join(F.broadcast(ids), "__id").select("__id", "label", "text")
            .mapInArrow(_features_of, "__id long, label int, x array<double>")
            .groupBy("__id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas())
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["label"].to_numpy(float)))       # sums in one fixed order
    return fit(x[order], rows["label"].to_numpy(float)[order])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _scores_of(shared):
    def run(batches):
        for batch in slices(batches):
            names = [c for c in batch.schema.names if c != "__text"]
            for lo, hi, buf, offs in byte_blocks(batch.column("__text")):
                score = shared.value.score(block_features(buf, offs))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(score)], names=[*names, "__score"])
    return run


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``__score`` (0 to 1) over the whole text.

    Only the text is read for the score. Null and empty texts are scored as texts
    without words; repeated rows get equal scores; an empty table gives no rows. A column
    ``__score`` of ``docs``, in any case, is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, names = stowed(docs, ("__score",))
    work = docs.select(*kept, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in work.schema if f.name != "__text")
    return work.mapInArrow(_scores_of(shared), f"{fields}__score double").toDF(*names, "__score")


def op9_quality_gam(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    work = docs.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "text")
    scored = score_quality(work, model)
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"),
                         (F.col("__score") >= 0.7).cast("int").alias("predicted"))
