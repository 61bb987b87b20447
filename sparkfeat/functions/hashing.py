"""Deterministic, partitioning-independent randomness.

A row's random number is derived from ``md5(seed | salt | id)``: the first
8 hex digits read as an unsigned 32-bit integer. The same value comes out
whatever the partitioning, after a retry, and in DuckDB
(``cast('0x' || substr(md5(...), 1, 8) as bigint)``), unlike ``rand()``.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = float(2 ** 32)


def _key(seed, id_col, salt: str | None) -> Column:
    parts = [F.lit(str(seed))]
    if salt is not None:
        parts.append(F.lit(str(salt)))
    parts.append(F.col(id_col).cast("string") if isinstance(id_col, str)
                 else id_col.cast("string"))
    return F.concat_ws("|", *parts)


def hash32(id_col, seed=42, salt: str | None = None) -> Column:
    """Unsigned 32-bit integer (bigint) from md5 of seed|salt|id."""
    h = F.md5(_key(seed, id_col, salt))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def uniform(id_col, seed=42, salt: str | None = None) -> Column:
    """Value in [0, 1)."""
    return hash32(id_col, seed, salt) / F.lit(TWO32)


def gaussian(id_col, seed=42, salt: str | None = None) -> Column:
    """Standard normal by Box-Muller over two hash uniforms (u1 in (0, 1])."""
    u1 = (hash32(id_col, seed, f"{salt}|u1") + F.lit(1.0)) / F.lit(TWO32)
    u2 = hash32(id_col, seed, f"{salt}|u2") / F.lit(TWO32)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def py_hash32(*parts) -> int:
    """Driver-side twin of ``hash32`` for small parameter tables."""
    key = "|".join(str(p) for p in parts)
    return int(hashlib.md5(key.encode("utf-8")).hexdigest()[:8], 16)


# SQL (DuckDB) twins used by the oracle strings.
def sql_hash32(id_sql: str, seed=42, salt: str | None = None) -> str:
    parts = [f"'{seed}'"] + ([f"'{salt}'"] if salt is not None else []) + [f"cast({id_sql} as varchar)"]
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) as bigint)"


def sql_uniform(id_sql: str, seed=42, salt: str | None = None) -> str:
    return f"({sql_hash32(id_sql, seed, salt)} / {TWO32!r})"


def sql_gaussian(id_sql: str, seed=42, salt: str | None = None) -> str:
    u1 = f"(({sql_hash32(id_sql, seed, f'{salt}|u1')} + 1.0) / {TWO32!r})"
    u2 = f"({sql_hash32(id_sql, seed, f'{salt}|u2')} / {TWO32!r})"
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"
