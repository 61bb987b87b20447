"""Exact order statistics without a single-task window.

An unpartitioned window (or one partitioned by a low-cardinality key such as a class or a
feature name) sends the whole group to one task. Here rows are dealt by range of the whole
order key (``ranged``): Spark samples the cut points, sizes the ranges from the measured
rows and finds a row's range by tree search. The dealt rows are written once, so the input
runs once. Range totals give each range its offset, and the window runs per (group, range)
only. Results are exact. Uniform hashes need no sampling: their ranges are arithmetic.

A cut-off (``top_n``) needs no order at all: ``radix_cut`` counts rows per digit of the
order key's bits and descends into the digit that holds the wanted row.

The totals table has at most ``groups + ranges`` rows; it is joined without a hint, so AQE
broadcasts it after measuring it at run time (or keeps a sort-merge join).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import TWO32
from sparkfeat.session import written

DIGIT = 16               # bits counted in a pass of ``radix_cut``
FEW = 10_000             # rows whose keys are looked at one by one instead
MOST = 2 ** 63 - 1


def _with_offsets(tagged: DataFrame, part_cols, weight_cols) -> DataFrame:
    """Join each row to the running total of the buckets before its own."""
    totals = tagged.groupBy(*part_cols, "__bucket").agg(*[F.sum(c).alias(f"__b_{c}") for c in weight_cols])
    before = (Window.partitionBy(*part_cols).orderBy("__bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*part_cols)
    offs = totals.select(
        *part_cols, "__bucket",
        *[F.coalesce(F.sum(f"__b_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in weight_cols],
        *[F.sum(f"__b_{c}").over(whole).alias(f"__tot_{c}") for c in weight_cols])
    # groups × buckets rows. No hint: AQE sees the materialised size of this
    # small aggregate at run time and broadcasts it (a checked size); with very
    # many groups it stays a sort-merge join instead of a blind broadcast
    # Null groups (a null label, a missing source) are groups like any other.
    right = offs.withColumnsRenamed({c: f"__p_{c}" for c in part_cols} | {"__bucket": "__p___bucket"})
    cond = F.col("__bucket").eqNullSafe(F.col("__p___bucket"))
    for c in part_cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    return tagged.join(right, cond).drop("__p___bucket", *[f"__p_{c}" for c in part_cols])


def rank_by_hash(df: DataFrame, part_cols, hash_col: str, tie_col: str,
                 n_buckets: int = 1 << 16, out: str = "rank") -> DataFrame:
    """1-based row number within ``part_cols`` ordered by (hash, tie).

    ``hash_col`` must hold uniform 32-bit values, so hash-range buckets are
    equal in size whatever the skew of the groups. The bucket is arithmetic
    (no search), so many buckets cost nothing per row: 2^16 keeps a window
    group near 10^7 rows even for 10^12 rows per class, while the offset
    table stays at classes × 2^16 rows.
    """
    part_cols = list(part_cols)
    b = F.floor(F.col(hash_col) * F.lit(float(n_buckets)) / F.lit(TWO32)).cast("int")
    tagged = df.withColumn("__bucket", b).withColumn("__one", F.lit(1))
    joined = _with_offsets(tagged, part_cols, ["__one"])
    w = Window.partitionBy(*part_cols, "__bucket").orderBy(hash_col, tie_col)
    return (joined.withColumn(out, F.col("__off___one") + F.row_number().over(w))
            .drop("__bucket", "__one", "__off___one", "__tot___one"))


def ranged(df: DataFrame, cols, n_buckets: int | None = None) -> DataFrame:
    """Rows dealt by range of ``cols`` and written, with the number of their range in ``__bucket``.

    Without ``n_buckets`` the number follows from the rows' measured size (AQE joins small ranges).
    """
    dealt = df.repartitionByRange(n_buckets, *cols) if n_buckets else df.repartitionByRange(*cols)
    return written(dealt.withColumn("__bucket", F.spark_partition_id()), "ranged")


def cumulative(df: DataFrame, part_cols, value_col: str, weight_cols, n_buckets: int | None = None) -> DataFrame:
    """Cumulative weights over distinct (group, value) rows in value order.

    Input: one row per distinct (part_cols, value_col) with numeric weight
    columns (hot values are already collapsed to one row). Output adds
    ``cum_<w>`` (weights of values ≤ this one), ``prev_<w>`` (values < this
    one) and ``tot_<w>`` (group total).
    """
    part_cols = list(part_cols)
    weight_cols = list(weight_cols)
    joined = _with_offsets(ranged(df, [*part_cols, value_col], n_buckets), part_cols, weight_cols)
    w = (Window.partitionBy(*part_cols, "__bucket").orderBy(value_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined.withColumns({f"cum_{c}": F.col(f"__off_{c}") + F.sum(c).over(w) for c in weight_cols})
    out = out.withColumns({f"prev_{c}": F.col(f"cum_{c}") - F.col(c) for c in weight_cols})
    out = out.withColumnsRenamed({f"__tot_{c}": f"tot_{c}" for c in weight_cols})
    return out.drop("__bucket", *[f"__off_{c}" for c in weight_cols])


def row_positions(df: DataFrame, order_cols, out: str = "position", total: str | None = None) -> DataFrame:
    """0-based position of every row in the order of ``order_cols`` (and the number of rows in ``total``)."""
    tagged = ranged(df, order_cols).withColumn("__one", F.lit(1))
    joined = _with_offsets(tagged, [], ["__one"])
    w = Window.partitionBy("__bucket").orderBy(*order_cols)
    joined = joined.withColumn(out, F.col("__off___one") + F.row_number().over(w) - 1)
    if total:
        joined = joined.withColumn(total, F.col("__tot___one"))
    return joined.drop("__bucket", "__one", "__off___one", "__tot___one")


def unpivot_numeric(df: DataFrame, id_cols, cols, var: str = "feature",
                    val: str = "value") -> DataFrame:
    """Long form (id_cols..., feature, value) of numeric columns, nulls dropped."""
    long = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(id_cols), list(cols), var, val)
    return long.filter(F.col(val).isNotNull())


def quantile_rows(df: DataFrame, cols, probs, by: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """(feature, [grp,] p, value): quantiles by linear interpolation (= ``percentile`` /
    ``quantile_cont``) per column and group, as a distributed table.

    Distinct values are counted (map-side combined) and ranked with ``cumulative``; each target
    rank p·(N − 1) lies between the two values that hold its floor and its ceiling. ``grp`` is
    the group as a string; a null group is a group. Columns without a value have no rows.
    """
    keys = ["feature"] + (["grp"] if by else [])
    long = unpivot_numeric(df.withColumn("grp", F.col(by).cast("string")) if by else df, keys[1:], cols)
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    cum = cumulative(counts, keys, "value", ["n"], n_buckets)
    lo, hi = F.floor("pos"), F.ceil("pos")
    at = lambda rank: (F.col("prev_n") <= rank) & (rank < F.col("cum_n"))
    hit = (cum.select(*keys, "value", "prev_n", "cum_n", "tot_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
           .withColumn("pos", F.col("p") * (F.col("tot_n") - 1)).filter(at(lo) | at(hi)))
    two = hit.groupBy(*keys, "p").agg(F.max("pos").alias("pos"), F.max(F.when(at(lo), F.col("value"))).alias("lo"),
                                      F.max(F.when(at(hi), F.col("value"))).alias("hi"))
    return two.select(*keys, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))).alias("value"))


def exact_quantiles(df: DataFrame, cols, probs, by: str | None = None, n_buckets: int | None = None) -> dict:
    """``quantile_rows`` on the driver: {(col, p)} or {(col, by_value, p)} → value, for few groups."""
    return {((r.feature, r.grp, r.p) if by else (r.feature, r.p)): r.value
            for r in quantile_rows(df, cols, probs, by, n_buckets).collect()}


# ------------------------------------------------------------------ cut-offs
_WHOLE = ("tinyint", "smallint", "int", "bigint", "boolean")


def order_bits(col, kind: str):
    """A long that rises with the value: whole numbers, dates and times as they are, floating
    numbers by their bits (-0.0 as 0.0, NaN above all), decimals by their nearest double;
    None for other types."""
    if kind in _WHOLE:
        return col.cast("bigint")
    if kind == "date":
        return F.unix_date(col).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_micros(col.cast("timestamp"))
    if kind in ("float", "double") or kind.startswith("decimal"):
        known = F.coalesce(col.cast("double") + F.lit(0.0), F.lit(0.0))
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), known).cast("bigint")
        return F.when(col.isNotNull(), F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(MOST))))
    return None


def radix_cut(df: DataFrame, key: str, n: int):
    """(cut, below, at): the nth smallest value of the long column ``key``, how many rows are
    smaller and how many equal; None with fewer than ``n`` rows.

    A pass counts rows per digit of the keys' upper differing bits (map-side combined, at most
    2^16 + 1 groups) and descends into the digit that holds the nth row: four passes at most
    after the range is known, whatever the distribution. Few rows are looked at directly.
    """
    keys = df.select(F.col(key).alias("k")).filter("k IS NOT NULL")
    total, lo, hi = keys.agg(F.count("*"), F.min("k"), F.max("k")).first()
    if total < n:
        return None
    below, here = 0, total
    while lo < hi:
        inside = keys.filter(F.col("k").between(lo, hi))
        if here <= FEW:
            seen = sorted(r[0] for r in inside.collect())
            cut = seen[n - below - 1]
            return cut, below + bisect_left(seen, cut), bisect_right(seen, cut) - bisect_left(seen, cut)
        shift = max(0, (hi - lo).bit_length() - DIGIT)
        digits = inside.groupBy((F.shiftright("k", shift) - F.lit(lo >> shift)).alias("d")).agg(
            F.count("*"), F.min("k"), F.max("k")).collect()
        for _, here, lo, hi in sorted(map(tuple, digits)):
            if below + here >= n:
                break
            below += here
    return lo, below, here


def top_n(df: DataFrame, score_col: str, id_col: str, n: int, descending: bool = True) -> DataFrame:
    """The n rows with the highest (or lowest) score, ties broken by id, exact.

    The rows are written once; ``radix_cut`` finds the cut-off, rows inside it are kept by a
    filter, and in the boundary group (equal scores, or the null scores, which come last) the
    smallest ids, again by ``radix_cut`` where the id's type has ordered bits. No shuffle of
    rows or of distinct scores. Ids are unique; rows that repeat a boundary id stay or go together.
    """
    if n <= 0:
        return df.limit(0)
    kinds = dict(df.dtypes)
    bits = order_bits(F.col(score_col), kinds[score_col])
    if bits is None:
        raise TypeError(f"{score_col}: scores of type {kinds[score_col]} have no order by bits")
    key = F.bitwise_not(bits) if descending else bits
    base = written(df.withColumn("__key", key), "scores")
    found = radix_cut(base, "__key", n)
    if found is None:
        inside, tie = F.col("__key").isNotNull(), F.col("__key").isNull()
        need = n - base.filter(inside).count()
    else:
        cut, below, at = found
        inside, tie, need = F.col("__key") < cut, F.col("__key") == cut, n - below
        if need == at and not kinds[score_col].startswith("decimal"):
            return base.filter(inside | tie).drop("__key")
    if need <= 0:
        return base.filter(inside).drop("__key")
    ties = base.filter(tie)
    if kinds[score_col].startswith("decimal"):            # equal doubles, maybe unequal decimals
        score = F.col(score_col).desc() if descending else F.col(score_col).asc()
        first = row_positions(ties, [score, F.col(id_col)], "__at").filter(F.col("__at") < need).drop("__at")
        return base.filter(inside).unionByName(first).drop("__key")
    ids = ties.select(F.col(id_col).alias("__id")).distinct()
    by_bits = order_bits(F.col("__id"), kinds[id_col]) if kinds[id_col] in (*_WHOLE, "date") else None
    if by_bits is not None:
        last = radix_cut(ids.select(by_bits.alias("b")), "b", need)
        chosen = F.lit(True) if last is None else F.coalesce(order_bits(F.col(id_col), kinds[id_col]) <= last[0], F.lit(False))
        return base.filter(inside | (tie & chosen)).drop("__key")
    codes = dense_codes(ids.select(F.lit(0).alias("g"), "__id"), "g", "__id")
    picked = codes.filter(F.col("code") < need).select("__id")
    return (base.filter(inside).unionByName(ties.join(picked, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi"))
            .drop("__key"))


def dense_codes(distinct: DataFrame, part_col: str, value_col: str, n_buckets: int | None = None) -> DataFrame:
    """0-based position of each distinct value within its group, in sort
    order, for any orderable type (strings included) — exact.

    Input: one row per distinct (group, value), dealt by range of (group, value).
    """
    tagged = ranged(distinct, [part_col, value_col], n_buckets).withColumn("__one", F.lit(1))
    joined = _with_offsets(tagged, [part_col], ["__one"])
    w = Window.partitionBy(part_col, "__bucket").orderBy(value_col)
    return (joined.withColumn("code", (F.col("__off___one") + F.row_number().over(w) - 1).cast("int"))
            .drop("__bucket", "__one", "__off___one", "__tot___one"))
