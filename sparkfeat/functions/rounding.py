"""Rounding used to compare doubles whose last bits depend on summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sig6(c) -> Column:
    """6 significant digits; powers of ten are exact (|exponent| ≤ 22)."""
    x = F.col(c) if isinstance(c, str) else c
    e = F.floor(F.log10(F.abs(x))).cast("int")
    up = F.pow(F.lit(10.0), F.lit(5) - e)
    down = F.pow(F.lit(10.0), e - F.lit(5))
    return (F.when(x.isNull() | (x == 0), x)
            .when(F.lit(5) - e >= 0, F.round(x * up, 0) / up)
            .otherwise(F.round(x / down, 0) * down))
