"""SimHash near-duplicate detection with bit-sliced comparison.

Fingerprints within ``radius`` bits agree on at least m - radius of any m bands
of bits, so every linked pair meets in a group that shares such bands (m grows
with the number of fingerprints and only sets the group size; nothing is lost
for any m). Inside a group the fingerprints stand vertically: word k of plane b
holds bit b of 64 fingerprints. One pass over the planes adds the mismatches of
a fingerprint with 64 others at once in carry-save counters; blocks whose 64
lanes all exceed the radius are abandoned on the way. A task returns one edge
per fingerprint at most (to the smallest member of its local component), never
the pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import U64, byte_blocks, materialize, slices, table
from sparkfeat.llm.components import components

GROUP_TARGET = 2_000     # expected fingerprints in a group when choosing the number of bands
BLOCK = 512              # larger groups are compared in pairs of blocks of about this size
ENTRIES = 1 << 18        # (fingerprint, 64 others) entries compared at once
FULL = U64(0xFFFFFFFFFFFFFFFF)


# ------------------------------------------------------------------ fingerprints

def _block_fingerprints(raw: bytes, offs: np.ndarray, shingle: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashes, sizes = [], []
    for a, b in zip(offs[:-1], offs[1:]):
        words = raw[a:b].lower().split()        # bytes.lower() folds A-Z only
        n = len(words)
        if not n:
            sizes.append(0)
            continue
        line = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(line, 42))
            sizes.append(1)
            continue
        at = np.zeros(n + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
        hashes += [digest(line[i:j], 42) for i, j in
                   zip(at[:n - shingle + 1].tolist(), (at[shingle:] - 1).tolist())]
        sizes.append(n - shingle + 1)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(sizes), U64)
    some = sizes > 0
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(sizes) - sizes
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
        major = (2 * ones > sizes[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints_of(shingle):
    def run(batches):
        for batch in slices(batches):
            for lo, hi, buf, offs in byte_blocks(batch.column("text")):
                fp = _block_fingerprints(buf.tobytes(), offs, shingle)
                names = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(fp.view(np.int64))],
                    names=[*names, "fp"])
    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, long columns ``keep``, fp): 64-bit SimHash of XXH64 (seed 42) over word shingles, one row per input row.

    A-Z are folded; words are runs of bytes other than the six ASCII white-space
    bytes; fewer words than a shingle hash whole; none (null, empty) give zero.
    """
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).alias("text"))
            .mapInArrow(_fingerprints_of(shingle), ", ".join(f"{c} long" for c in ("doc_id", *keep, "fp"))))


# ------------------------------------------------------------------ bit-sliced comparison

def _planes(fps: np.ndarray, slot: np.ndarray, n_words: int) -> np.ndarray:
    """planes[b, k]: bit b of the 64 fingerprints in word k; ``slot`` = 64 * word + lane."""
    padded = np.zeros(n_words * 64, "<u8")
    padded[slot] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(n_words, 64, 8), axis=2, bitorder="little")
    return np.packbits(bits.transpose(2, 0, 1).copy(), axis=2, bitorder="little").view("<u8").reshape(64, n_words)


def _close(planes, fps, entry_row, entry_word, valid, bits, radius):
    """For each entry, the lanes of its word within ``radius`` of its fingerprint.

    Counters hold 1, 2, 4, ... mismatches; ``over`` marks lanes past the top one.
    Entries without a lane left are abandoned every few planes.
    """
    levels = int(radius).bit_length()
    count = [np.zeros(len(entry_row), U64) for _ in range(levels)]
    over = ~valid
    row, word, keep = entry_row, entry_word, np.arange(len(entry_row))
    value = fps[row]
    for k in range(0, len(bits), 2):
        pair = bits[k:k + 2]
        x = planes[pair[0]][word] ^ (U64(0) - ((value >> U64(pair[0])) & U64(1)))
        if len(pair) == 2:
            y = planes[pair[1]][word] ^ (U64(0) - ((value >> U64(pair[1])) & U64(1)))
            u = count[0] ^ x
            carry = (count[0] & x) | (u & y)
            count[0] = u ^ y
        else:
            carry = count[0] & x
            count[0] = count[0] ^ x
        for level in range(1, levels):
            carry, count[level] = count[level] & carry, count[level] ^ carry
        over |= carry
        if k % 8 == 6 and k >= 14:
            alive = ~(over | _beyond(count, radius)) != 0
            if alive.mean() < 0.7:
                row, word, keep, over, value = row[alive], word[alive], keep[alive], over[alive], value[alive]
                count = [c[alive] for c in count]
                if not len(row):
                    break
    return keep, ~(over | _beyond(count, radius))


def _beyond(count, radius):
    """Lanes whose counter is over the radius, compared bit by bit from the top."""
    more, equal = np.zeros_like(count[0]), np.full_like(count[0], FULL)
    for level in reversed(range(len(count))):
        if radius >> level & 1:
            equal &= count[level]
        else:
            more |= equal & count[level]
            equal &= ~count[level]
    return more


def _local_components(n, a, b):
    """Smallest row of each row's component over the links (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))     # hook the larger root
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def compare_groups(fps: np.ndarray, side: np.ndarray, group: np.ndarray, bits: list[int], radius: int):
    """Edges (row, smallest linked row) inside each group; rows of one group are adjacent.

    ``side`` 0/1 marks the two blocks of a split group: only links between the
    blocks are looked for there (links inside a block have their own group).
    ``side`` -1: all links of the group.
    """
    n = len(fps)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))
    words = (size + 63) // 64
    word0 = np.cumsum(words) - words
    member = np.repeat(np.arange(len(start)), size)
    lane = np.arange(n) - start[member]
    slot = word0[member] * 64 + lane
    total = int(words.sum())
    filled = np.zeros(total * 64, np.uint8)
    filled[slot] = 1
    lanes = np.packbits(filled, bitorder="little").view("<u8")
    filled[slot] = (side == 1)
    right = np.packbits(filled, bitorder="little").view("<u8")
    planes = _planes(fps, slot, total)
    # Row r against the words from its own on (all words, right block only, if the group is split).
    whole = side == -1
    skip = np.where(whole, lane // 64, 0)
    per_row = np.where(side == 1, 0, words[member] - skip)
    links_a, links_b = [], []
    upto = np.cumsum(per_row)
    lo = 0
    while lo < n:
        done = upto[lo - 1] if lo else 0
        hi = min(n, max(lo + 1, int(np.searchsorted(upto, done + ENTRIES, side="right"))))
        rows = np.repeat(np.arange(lo, hi), per_row[lo:hi])
        if len(rows):
            step = np.arange(len(rows)) - np.repeat(upto[lo:hi] - per_row[lo:hi] - done, per_row[lo:hi])
            word = word0[member[rows]] + skip[rows] + step
            valid = np.where(whole[rows], lanes[word], right[word])
            own = whole[rows] & (step == 0)                    # in its own word: later lanes only
            valid = np.where(own, valid & ((FULL << (lane[rows] % 64).astype(U64)) & ~(U64(1) << (lane[rows] % 64).astype(U64))), valid)
            some = valid != 0
            rows, word, valid = rows[some], word[some], valid[some]
            keep, alive = _close(planes, fps, rows, word, valid, bits, radius)
            hit = alive != 0
            keep, alive = keep[hit], alive[hit]
            if len(keep):
                e, l = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a = rows[keep[e]]
                at = word[keep[e]] * 64 + l
                b = start[member[a]] + at - word0[member[a]] * 64
                # keep a spanning forest of what was found so far, not the pairs
                links_a.append(a)
                links_b.append(b)
                if sum(map(len, links_a)) > 4 * n + 1_000_000:
                    label = _local_components(n, np.concatenate(links_a), np.concatenate(links_b))
                    far = np.flatnonzero(label != np.arange(n))
                    links_a, links_b = [far], [label[far]]
        lo = hi
    if not links_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = _local_components(n, np.concatenate(links_a), np.concatenate(links_b))
    far = np.flatnonzero(label != np.arange(n))
    return far, label[far]


def _edges_of(masks, radius, max_rows=1 << 15):
    """Stream sorted rows (combo, shared, i, j, side, fp); groups are cut at key changes."""
    def flush(rows):
        combo, shared, i, j, side, fp = rows
        new = np.ones(len(fp), bool)
        new[1:] = ((combo[1:] != combo[:-1]) | (shared[1:] != shared[:-1])
                   | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        group = np.cumsum(new)
        a_all, b_all = [], []
        for c in np.unique(combo):
            own = np.flatnonzero(combo == c)
            bits = [b for b in range(64) if not masks[c] >> b & 1]
            bits = bits[::2] + bits[1::2]
            a, b = compare_groups(fp[own], side[own], group[own], bits, radius)
            a_all.append(fp[own][a])
            b_all.append(fp[own][b])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in slices(batches):
            cols = [np.asarray(batch.column(k)) for k in ("combo", "shared", "i", "j", "side")]
            cols.append(np.ascontiguousarray(np.asarray(batch.column("fp"))).view(U64))
            if not len(cols[0]):
                continue
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) >= max_rows:
                last = [x[-1] for x in held[:4]]
                same = np.logical_and.reduce([x == v for x, v in zip(held[:4], last)])
                cut = int(np.argmax(same))               # the last group may go on
                if cut:
                    yield flush([x[:cut] for x in held])
                    held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield flush(held)
    return run


def band_masks(n: int, radius: int) -> list[int]:
    """Masks of the shared bits: all choices of m - radius out of m bands."""
    m = radius + 1
    while n / 2 ** (64 * (m - radius) // m) > GROUP_TARGET and m < 4 * radius + 4:
        m += 1
    cuts = [64 * k // m for k in range(m + 1)]
    band = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]
    return [sum(band[k] for k in c) for c in combinations(range(m), m - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def linked_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    masks = band_masks(distinct.count(), radius)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(c).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shared"))
        for c, m in enumerate(masks)])).alias("k")).select("k.combo", "k.shared", "fp")
    large = materialize(keyed.groupBy("combo", "shared").count().where(F.col("count") > BLOCK)
                        .select("combo", "shared", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    split = (keyed.join(large, ["combo", "shared"], "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("s", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("combo", "shared", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"),
                     F.when(F.col("s") == F.col("t"), -1).when(F.col("s") < F.col("t"), 0).otherwise(1).alias("side"), "fp"))
    keys = ["combo", "shared", "i", "j"]
    return (split.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_edges_of(masks, radius), "a long, b long"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, long columns ``keep``, fp, root, component_id), one row per input row.

    ``root`` tells the groups apart; component_id need not (see ``near_duplicates``): groups
    without an id have none, and a repeated doc_id can be the smallest of several groups.
    """
    marks = materialize(fingerprints(docs, doc_id, text, shingle, keep), "fingerprints")
    distinct = materialize(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    label = components(linked_edges(distinct.select("fp"), radius))
    joined = distinct.join(label, distinct.fp == label.v, "left").select(
        "fp", "low", F.coalesce("label", "fp").alias("root"))
    joined = materialize(joined, "roots")
    lows = materialize(joined.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    ids = materialize(joined.join(lows, "root").select("fp", "root", "component_id"), "ids")
    return marks.join(ids, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest doc_id reachable over fingerprints that differ
    in at most ``radius`` bits. Null, empty and blank texts have fingerprint zero
    and link like any other. A null doc_id is fingerprinted and linked but never
    becomes a component id unless nothing else is there (then null). Repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """
    return near_groups(docs, doc_id, text, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_groups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
