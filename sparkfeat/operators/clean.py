"""Projections, casts, value maps (PRJ-*) and missing values (IMP-*).

Fitted fills keep their state on the driver only when it is proven small
(one value per column, or per (class, column)); every statistic is computed
by one distributed aggregate over all columns at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.functions.ordered import exact_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


# ----------------------------------------------------------------- PRJ-1/2/13
def columns_of_kind(df: DataFrame, kind: str, exclude=()) -> list[str]:
    """PRJ-2: column names by type, from the schema (metadata only)."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        is_num = isinstance(f.dataType, NUMERIC_TYPES)
        if (kind == "numeric" and is_num) or (kind == "string" and isinstance(f.dataType, T.StringType)):
            out.append(f.name)
    return out


def drop_keys(df: DataFrame, *keys: str) -> DataFrame:
    """PRJ-1: keep feature columns only."""
    return df.drop(*keys)


def align_columns(df: DataFrame, columns) -> DataFrame:
    """PRJ-13: select an ordered column list; a missing column is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing for alignment: {missing}")
    return df.select(*columns)


# ------------------------------------------------------------------ PRJ-3..14
def coerce_double(c) -> Column:
    """PRJ-3: bad text becomes null (ANSI cast would raise)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast("double")


def map_values(c, mapping: dict, default=None) -> Column:
    """PRJ-4/5: dictionary map; unknown and missing get ``default``."""
    col = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default))


def to_class(p, threshold: float = 0.5, inclusive: bool = False) -> Column:
    """PRJ-6: probability → 0/1; ``inclusive`` uses >= (baseline family)."""
    col = F.col(p) if isinstance(p, str) else p
    return (col >= threshold if inclusive else col > threshold).cast("int")


def confidence(p) -> Column:
    """PRJ-14: max(p, 1 − p)."""
    col = F.col(p) if isinstance(p, str) else p
    return F.greatest(col, F.lit(1.0) - col)


def int_string(c) -> Column:
    """PRJ-8: missing → -1 → small int → text."""
    return F.coalesce(F.col(c), F.lit(-1)).cast("smallint").cast("string")


def float_string(c) -> Column:
    """PRJ-9: missing → -1 → text of the double ("4.0", "-1.0")."""
    return F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).cast("string")


def category_string(c, missing: str = "missing") -> Column:
    """PRJ-10: missing → "missing" (fill before any text conversion, T9)."""
    return F.coalesce(F.col(c).cast("string"), F.lit(missing))


def truncate_int(c) -> Column:
    """PRJ-11: toward zero."""
    return (F.col(c) if isinstance(c, str) else c).cast("int")


# --------------------------------------------------------------------- IMP-1
def fill_constant(df: DataFrame, cols, value=0) -> DataFrame:
    return df.fillna(value, subset=list(cols))


# --------------------------------------------------------------------- IMP-2
def fit_median(df: DataFrame, cols) -> dict:
    """Exact medians (linear interpolation), distributed."""
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols if (c, 0.5) in q}     # an all-null column has none


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


# --------------------------------------------------------------------- IMP-3
def fit_class_mean(df: DataFrame, cols, label: str) -> dict:
    """{label value: {col: mean}} — one aggregate, one row per class."""
    rows = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols]).collect()
    return {r[label]: {c: r[c] for c in cols} for r in rows}


def apply_class_fill(df: DataFrame, values: dict, label: str, fallback: dict | None = None) -> DataFrame:
    out = {}
    for c in next(iter(values.values())).keys() if values else []:
        expr = None
        for lab, m in values.items():
            cond = F.col(label) == F.lit(lab)
            expr = F.when(cond, F.lit(m[c])) if expr is None else expr.when(cond, F.lit(m[c]))
        expr = expr.otherwise(F.lit(fallback[c] if fallback else None))
        out[c] = F.coalesce(F.col(c), expr)
    return df.withColumns(out)


# --------------------------------------------------------------------- IMP-4
def fit_modes(df: DataFrame, num_cols=(), str_cols=(), by: str | None = None) -> dict:
    """Most frequent value per column, per class of ``by`` and overall, in ONE
    aggregation; ties → lowest value (numeric order for numbers, text order
    for strings).

    Counts per (class, column, value) are map-side combined; the winner per
    (class, column) is ``min(struct(-count, value))`` — an aggregate, so no
    group's values are ever gathered in one place. Result:
    ``{class value: {col: mode}}`` with the overall modes under key ``None``.
    """
    keys = [F.col(by).cast("string")] if by else []
    num = df.select(*[k.alias("__g") for k in keys], *[F.col(c).cast("double").alias(c) for c in num_cols])
    st = df.select(*[k.alias("__g") for k in keys], *[F.col(c).cast("string").alias(c) for c in str_cols])
    parts = []
    g = ["__g"] if by else []
    if num_cols:
        parts.append(num.unpivot(g, list(num_cols), "feature", "vd").withColumn("vs", F.lit(None).cast("string")))
    if str_cols:
        parts.append(st.unpivot(g, list(str_cols), "feature", "vs").withColumn("vd", F.lit(None).cast("double")))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    long = long.filter(F.col("vd").isNotNull() | F.col("vs").isNotNull())
    if by:  # every row also counts for the overall mode
        long = long.withColumn("__g", F.explode(F.array(F.col("__g"), F.lit("\u0000all"))))
    else:
        long = long.withColumn("__g", F.lit("\u0000all"))
    counts = long.groupBy("__g", "feature", "vd", "vs").agg(F.count("*").alias("n"))
    best = counts.groupBy("__g", "feature").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("vd"), F.col("vs"))).alias("b"))
    out: dict = {}
    for r in best.select("__g", "feature", "b.vd", "b.vs").collect():  # ≤ classes × columns rows
        grp = None if r["__g"] == "\u0000all" else r["__g"]
        out.setdefault(grp, {})[r.feature] = r.vd if r.feature in num_cols else r.vs
    return out


def fit_mode(df: DataFrame, cols, by: str | None = None, kind: str = "double") -> dict:
    """Mode per column (per class when ``by``), see ``fit_modes``."""
    m = fit_modes(df, cols if kind == "double" else (), cols if kind != "double" else (), by)
    if not by:
        return m.get(None, {})
    label_type = dict(df.dtypes)[by]
    cast = int if label_type in ("int", "bigint", "smallint", "tinyint") else (lambda v: v)
    return {cast(k): v for k, v in m.items() if k is not None}


# --------------------------------------------------------------- IMP-6..9
def missing_flag_exprs(cols, suffix: str = "missing") -> dict:
    return {f"{c}_{suffix}": F.col(c).isNull().cast("int") for c in cols}


def missing_features(df: DataFrame, cols, groups: dict | None = None) -> DataFrame:
    """Flags, total, ratio, bit code Σ flag·2^i, named group counts."""
    flags = [F.col(c).isNull().cast("int") for c in cols]
    total = sum(flags[1:], flags[0])
    bits = sum((f * F.lit(2 ** i) for i, f in enumerate(flags[1:], start=1)), flags[0])
    exprs = missing_flag_exprs(cols)
    exprs["total_missing"] = total
    exprs["missing_ratio"] = total / F.lit(float(len(cols)))
    exprs["missing_bits"] = bits
    exprs["missing_pattern"] = F.concat(*[f.cast("string") for f in flags])
    for name, group in (groups or {}).items():
        g = [F.col(c).isNull().cast("int") for c in group]
        exprs[name] = sum(g[1:], g[0])
    return df.withColumns(exprs)


def pattern_codes(df: DataFrame, id_col: str, pattern_col: str = "missing_pattern",
                  out: str = "missing_pattern_code") -> DataFrame:
    """IMP-8: dense code of the sorted distinct patterns (many patterns are ranked in ranges)."""
    from sparkfeat.operators.encode import apply_codes, fit_codes
    codes = fit_codes(df, [pattern_col], None)
    return apply_codes(df, codes, [pattern_col], id_col, None, "__code").withColumnRenamed(f"{pattern_col}___code", out)


def missing_table(df: DataFrame, cols) -> DataFrame:
    """IMP-10: (feature, n_missing, pct_missing) from a single aggregate."""
    agg = df.agg(F.count("*").alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(c) for c in cols])
    long = agg.unpivot(["__n"], list(cols), "feature", "n_missing")
    return long.select("feature", "n_missing",
                       F.round(F.col("n_missing") * 100.0 / F.col("__n"), 6).alias("pct_missing"))


def missing_patterns(df: DataFrame, cols) -> DataFrame:
    """IMP-11: co-missing pattern table (count per combination of flags)."""
    flags = [F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols]
    return df.select(*flags).groupBy(*[f"{c}_missing" for c in cols]).agg(
        F.count("*").alias("n"))
