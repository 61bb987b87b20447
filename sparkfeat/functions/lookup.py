"""Fitted state tables and the joins that apply them.

A fitted operator's state is an aggregate (one row per category, fold,
column ...). ``State`` records whether its size was *proven* small: the
state is read with ``limit(max_rows + 1)`` and, when it fits, rebuilt as a
local relation — a broadcast of known size, independent of the lineage that
produced it. A state above the bound is checkpointed to the shared
checkpoint folder and applied with a shuffle join — salted for moderate
states, AQE skew-split otherwise — so one hot key cannot pin a third of the
rows on one task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.session import cut_lineage

MAX_BROADCAST_ROWS = 200_000
SALT_BUCKETS = 32


@dataclass
class State:
    df: DataFrame
    small: bool
    rows: list | None = None  # driver copy when small
    salt: bool = False  # large but moderate: replicate over salts (else AQE skew join)

    def collect(self) -> list:
        if self.rows is None:
            raise RuntimeError("state is not small; refusing to collect it")
        return self.rows


def fit_state(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> State:
    """Materialise an aggregate; small (≤ max_rows) states become local relations."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        local = df.sparkSession.createDataFrame(rows, df.schema)
        return State(local, True, rows)
    return State(cut_lineage(df), False, None)


def save_fitted(path: str, spark: SparkSession, **values) -> None:
    """Keep a fitted operator's parts under ``path``: tables (``State`` or DataFrame) as Parquet,
    the rest (numbers, strings, lists, dicts) as JSON in a one-row table."""
    plain = {}
    for name, value in values.items():
        if isinstance(value, (State, DataFrame)):
            table = value.df if isinstance(value, State) else value
            table.write.parquet(f"{path}/{name}")
            value = {"__table": "small" if isinstance(value, State) and value.small else "large"}
        plain[name] = value
    spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.text(f"{path}/values")


def load_fitted(path: str, spark: SparkSession) -> dict:
    """The parts that ``save_fitted`` kept; tables come back as ``State``, proven small again
    by their rows, or read from their files."""
    values = json.loads(spark.read.text(f"{path}/values").first()[0])
    for name, value in values.items():
        if isinstance(value, dict) and "__table" in value:
            table = spark.read.parquet(f"{path}/{name}")
            values[name] = fit_state(table) if value["__table"] == "small" else State(table, False)
    return values


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _digits(kind: str) -> tuple[int, int]:
    """Digits before and after the point of a whole or decimal type."""
    if kind in _WHOLE:
        return (3, 5, 10, 19)[_WHOLE.index(kind)], 0
    precision, scale = (int(x) for x in kind[len("decimal("):-1].split(","))
    return precision - scale, scale


def key_type(a: str, b: str) -> str:
    """The type in which keys of two types are compared: the wider of two whole or decimal
    types, double if either is floating, timestamp for a date and a timestamp, else string.
    No key of either side fails to convert or loses digits to a narrower type."""
    if a == b:
        return a
    exact = [t in _WHOLE or t.startswith("decimal") for t in (a, b)]
    floating = [t in ("float", "double") for t in (a, b)]
    if all(x or y for x, y in zip(exact, floating)):
        if any(floating):
            return "double"
        if a in _WHOLE and b in _WHOLE:
            return _WHOLE[max(_WHOLE.index(a), _WHOLE.index(b))]
        before, after = (max(x) for x in zip(_digits(a), _digits(b)))
        return f"decimal({min(38, before + after)},{min(after, 38)})"
    return "timestamp" if {a, b} == {"date", "timestamp"} else "string"


def _cond(left: DataFrame, right: DataFrame, keys, null_safe: bool) -> Column:
    parts, lt, rt = [], dict(left.dtypes), dict(right.dtypes)
    for lk, rk in keys:
        kind = key_type(lt[lk], rt[rk])
        # try_cast: a number beyond 38 digits matches nothing instead of ending the job
        lc, rc = (c if t == kind else c.try_cast(kind) for c, t in ((left[lk], lt[lk]), (right[rk], rt[rk])))
        parts.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    return reduce(lambda a, b: a & b, parts)


def _map_keeps_keys(df: DataFrame, state: State, keys) -> bool:
    """Whether different state keys stay different as map keys (rounding to double may merge them)."""
    lt, rt = dict(df.dtypes), dict(state.df.dtypes)
    kinds = [(key_type(lt[lk], rt[rk]), rt[rk]) for lk, rk in keys]
    return all(kind == own or kind in ("string", *_WHOLE) for kind, own in kinds)


MAP_LITERAL_MAX = 32  # map lookups scan their keys: keep maps tiny


def _map_lookup(df: DataFrame, state: State, keys, how: str) -> DataFrame:
    """Tiny proven state as a map literal: no join, no extra stage."""
    types, own = dict(state.df.dtypes), dict(df.dtypes)
    kinds = {rk: key_type(own[lk], types[rk]) for lk, rk in keys}
    rkeys = [rk for _, rk in keys]
    vals = [c for c in state.df.columns if c not in rkeys]

    def key_expr(parts):
        return parts[0] if len(parts) == 1 else F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    entries = []
    for r in state.rows:
        if any(r[k] is None for k in rkeys):
            continue  # a null key never matches an equi-join
        entries.append(key_expr([F.lit(r[k]).cast(types[k]).cast(kinds[k]) for k in rkeys]))
        entries.append(F.struct(*[F.lit(r[v]).cast(types[v]).alias(v) for v in vals]))
    if not entries:
        looked = F.lit(None).cast("struct<" + ",".join(f"`{v}`:{types[v]}" for v in vals) + ">")
    else:
        looked = F.try_element_at(F.create_map(*entries),
                                  key_expr([F.col(lk).cast(kinds[rk]) for lk, rk in keys]))
    out = df.withColumn("__lk", looked)
    if how == "inner":
        out = out.filter(F.col("__lk").isNotNull())
    return out.withColumns({v: F.col("__lk")[v] for v in vals}).drop("__lk")


def lookup_join(df: DataFrame, state: State, keys, *, salt_col: str | None = None,
                null_safe: bool = False, how: str = "left",
                drop_right_keys: bool = True, allow_map: bool = True) -> DataFrame:
    """Join ``df`` to a fitted state on ``keys`` = [(left_col, right_col), ...].

    Keys of different types are compared in ``key_type`` of the two, whatever the state's size.

    Tiny state (≤ MAP_LITERAL_MAX rows): a map-literal lookup inside the
    projection (no join, no stage; Spark scans map keys, so only tiny ones). Small state: broadcast hash join (no shuffle of ``df``). Large state with
    ``salt``: the state is replicated over ``SALT_BUCKETS`` salts and ``df``
    rows are spread by a hash of ``salt_col`` (the row id), so hot keys split
    across tasks. Other large states: plain join, where AQE checks the
    runtime size (broadcast or sort-merge) and splits skewed partitions.
    """
    keys = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    if (state.small and state.rows is not None and len(state.rows) <= MAP_LITERAL_MAX
            and allow_map and not null_safe and how in ("left", "inner") and drop_right_keys
            and _map_keeps_keys(df, state, keys)):
        return _map_lookup(df, state, keys, how)
    right = state.df
    # Rename state columns to avoid ambiguity with df columns.
    ren = {c: f"__r_{c}" for c in right.columns}
    right = right.select([F.col(c).alias(ren[c]) for c in right.columns])
    rkeys = [(lk, ren[rk]) for lk, rk in keys]
    if state.small:
        out = df.join(F.broadcast(right), _cond(df, right, rkeys, null_safe), how)
    elif not state.salt or salt_col is None:
        # size not proven: plain join; AQE broadcasts it if its runtime size is
        # under the threshold, else sort-merge with skewed partitions split
        out = df.join(right, _cond(df, right, rkeys, null_safe), how)
    else:
        left = df.withColumn("__salt", F.pmod(F.xxhash64(salt_col), F.lit(SALT_BUCKETS)))
        right = right.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))))
        cond = _cond(left, right, rkeys, null_safe) & (left["__salt"] == right["__rsalt"])
        out = left.join(right, cond, how).drop("__salt", "__rsalt")
    drop = [ren[rk] for _, rk in keys] if drop_right_keys else []
    out = out.drop(*drop)
    back = {ren[c]: c for c in state.df.columns if ren[c] in out.columns}
    return out.withColumnsRenamed(back) if back else out


def literal_map(pairs: dict, key_type: str | None = None) -> Column:
    """A bounded driver dict as a map literal (no join at all)."""
    items = []
    for k, v in pairs.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)
