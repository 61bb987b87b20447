"""Queries for projections, casts and missing values (PRJ-*, IMP-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.operators import clean as C
from sparkfeat.plans.sqlkit import r6, with_profile
from sparkfeat.sources.fixtures import ORDER_SPEC, order_profile, train_rows
from sparkfeat.sources.tables import read_table

NUMS = ORDER_SPEC.numeric
CATS = ORDER_SPEC.categorical
COUNTS = ("cnt_r", "cnt_a", "cnt_n")
ALL7 = ("cnt_r", "cnt_a", "cnt_n", "qty_r", "max_price", "st1", "seg")

# Fixed value maps (stand-ins for the Yes/No and ordinal maps of the survey data)
ST1_MAP = {"F": 1.0, "O": 0.0}
PRI_MAP = {"1-URGENT": 2.0, "2-HIGH": 2.0, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 0.0, "5-LOW": 0.0}


def _case(col, mapping, default):
    arms = " ".join(f"WHEN {col} = '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CAST(CASE {arms} ELSE {default!r} END AS DOUBLE)"


# ------------------------------------------------------------ PRJ-1/2/13
def feature_select(spark, sf):
    df = order_profile(spark, sf)
    nums = C.columns_of_kind(df, "numeric", exclude=("id", "label"))
    return C.align_columns(df, ["id"] + nums)


register("feature_select", with_profile() +
         "SELECT id, cnt_r, cnt_a, cnt_n, qty_r, max_price, total FROM order_profile")(feature_select)


# ------------------------------------------------------------- PRJ-8/9/10
def normalise_strings(spark, sf):
    df = order_profile(spark, sf)
    return df.select(
        "id",
        *[C.int_string(c).alias(f"{c}_i") for c in COUNTS],
        *[C.float_string(c).alias(f"{c}_f") for c in COUNTS],
        *[C.category_string(c).alias(f"{c}_s") for c in CATS])


register("normalise_strings", with_profile() + "SELECT id, " + ", ".join(
    [f"CAST(CAST(coalesce({c}, -1) AS SMALLINT) AS VARCHAR) AS {c}_i" for c in COUNTS] +
    [f"CAST(coalesce(CAST({c} AS DOUBLE), -1.0) AS VARCHAR) AS {c}_f" for c in COUNTS] +
    [f"coalesce({c}, 'missing') AS {c}_s" for c in CATS]) + " FROM order_profile")(normalise_strings)


# ------------------------------------------------- PRJ-4/5/6/7/11/12/14
def value_map(spark, sf):
    df = order_profile(spark, sf)
    p = F.col("total") / F.lit(600000.0)
    return df.filter(~F.col("is_test")).select(
        "id",
        C.map_values("st1", ST1_MAP, 0.5).alias("st1_num"),
        C.map_values("pri", PRI_MAP, 1.0).alias("pri_ord"),
        C.map_values(F.col("label").cast("string"), {"1": "F", "0": "other"}, "other").alias("status"),
        (F.lit(1) - F.col("label")).alias("label_inv"),
        C.to_class(p, 0.5, False).alias("cls_strict"),
        C.to_class(p, 0.5, True).alias("cls_incl"),
        C.confidence(p).alias("conf"),
        F.coalesce(C.truncate_int(F.col("qty_r")), F.lit(-1)).alias("qty_r_int"),
        F.lit(False).alias("is_pseudo"), F.lit(1.0).alias("weight"))


register("value_map", with_profile() + "SELECT id, " + ", ".join([
    _case("st1", ST1_MAP, 0.5) + " AS st1_num",
    _case("pri", PRI_MAP, 1.0) + " AS pri_ord",
    "CASE WHEN CAST(label AS VARCHAR) = '1' THEN 'F' ELSE 'other' END AS status",
    "1 - label AS label_inv",
    "CAST(total / 600000.0 > 0.5 AS INTEGER) AS cls_strict",
    "CAST(total / 600000.0 >= 0.5 AS INTEGER) AS cls_incl",
    "greatest(total / 600000.0, 1.0 - total / 600000.0) AS conf",
    "coalesce(CAST(trunc(qty_r) AS INTEGER), -1) AS qty_r_int",
    "false AS is_pseudo", "CAST(1.0 AS DOUBLE) AS weight"]) + " FROM order_profile WHERE NOT is_test")(value_map)


# ------------------------------------------------------------------ PRJ-3
def coerce_numeric(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id",
        C.coerce_double(F.get_json_object("props", "$.k")).alias("k"),
        C.coerce_double(F.substring("props", 7, 3)).alias("k_raw"),
        C.coerce_double(F.col("event_type")).alias("type_num"))


register("coerce_numeric",
         "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, "
         "TRY_CAST(substr(props, 7, 3) AS DOUBLE) AS k_raw, TRY_CAST(event_type AS DOUBLE) AS type_num "
         "FROM events")(coerce_numeric)


# ------------------------------------------------------------------ IMP-1
def fill_zero(spark, sf):
    df = order_profile(spark, sf)
    return C.fill_constant(df, NUMS, 0).select("id", *NUMS)


register("fill_zero", with_profile() + "SELECT id, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in NUMS) + " FROM order_profile")(fill_zero)


# ------------------------------------------------------------------ IMP-2
def fill_median(spark, sf):
    df = order_profile(spark, sf)
    med = C.fit_median(train_rows(df), NUMS)
    out = df.select("id", *[F.col(c).cast("double").alias(c) for c in NUMS])
    out = C.apply_fill(out, med)
    return out.withColumns({c: F.round(c, 6) for c in NUMS})


register("fill_median", with_profile(
    "m AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in NUMS) +
    " FROM order_profile WHERE NOT is_test)") + "SELECT id, " + ", ".join(
    f"{r6(f'coalesce(CAST({c} AS DOUBLE), m_{c})')} AS {c}" for c in NUMS) +
    " FROM order_profile, m")(fill_median)


# ------------------------------------------------------------------ IMP-3
def fill_class_mean(spark, sf):
    tr = train_rows(order_profile(spark, sf)).select(
        "id", "label", *[F.col(c).cast("double").alias(c) for c in NUMS])
    means = C.fit_class_mean(tr, NUMS, "label")
    out = C.apply_class_fill(tr, means, "label")
    return out.withColumns({c: F.round(c, 6) for c in NUMS})


register("fill_class_mean", with_profile(
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    "m AS (SELECT label, " + ", ".join(f"avg({c}) AS m_{c}" for c in NUMS) + " FROM tr GROUP BY label)"
) + "SELECT id, tr.label, " + ", ".join(
    f"{r6(f'coalesce(CAST({c} AS DOUBLE), m_{c})')} AS {c}" for c in NUMS) +
    " FROM tr JOIN m ON tr.label = m.label")(fill_class_mean)


# ------------------------------------------------------------------ IMP-4
def fill_class_mode(spark, sf):
    df = order_profile(spark, sf)
    tr = train_rows(df)
    modes = C.fit_modes(tr, COUNTS, ["st1"], by="label")  # one aggregation for all
    overall = modes.pop(None)
    by_class = {int(k): v for k, v in modes.items()}
    base = df.select("id", "label", "is_test", *[F.col(c).cast("double").alias(c) for c in COUNTS], "st1")
    # train rows: mode of their class; test rows: overall mode (T14)
    labelled = C.apply_class_fill(base.filter(~F.col("is_test")), by_class, "label")
    unlabelled = C.apply_fill(base.filter(F.col("is_test")), overall)
    return labelled.unionByName(unlabelled).drop("label")


def _mode_sql():
    parts = []
    for c, typ in [(c, "DOUBLE") for c in COUNTS] + [("st1", "VARCHAR")]:
        parts.append(
            f"SELECT label, '{c}' AS feature, CAST({c} AS {typ}) AS v, count(*) AS n FROM tr "
            f"WHERE {c} IS NOT NULL GROUP BY label, {c}")
    return parts


_m = _mode_sql()
_num_u = "\nUNION ALL\n".join(_m[:3])
register("fill_class_mode", with_profile(
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    f"cn AS ({_num_u})",
    f"cc AS ({_m[3]})",
    "bn AS (SELECT label, feature, v FROM (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY n DESC, v) AS rk FROM cn) WHERE rk = 1)",
    "bc AS (SELECT label, feature, v FROM (SELECT *, row_number() OVER (PARTITION BY label, feature ORDER BY n DESC, v) AS rk FROM cc) WHERE rk = 1)",
    "an AS (SELECT feature, v FROM (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY sum(n) DESC, v) AS rk FROM cn GROUP BY feature, v) WHERE rk = 1)",
    "ac AS (SELECT feature, v FROM (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY sum(n) DESC, v) AS rk FROM cc GROUP BY feature, v) WHERE rk = 1)",
) + "SELECT p.id, p.is_test, " + ", ".join(
    [f"coalesce(CAST(p.{c} AS DOUBLE), CASE WHEN p.is_test THEN (SELECT v FROM an WHERE feature = '{c}') "
     f"ELSE (SELECT v FROM bn WHERE feature = '{c}' AND bn.label = p.label) END) AS {c}" for c in COUNTS] +
    ["coalesce(p.st1, CASE WHEN p.is_test THEN (SELECT v FROM ac WHERE feature = 'st1') "
     "ELSE (SELECT v FROM bc WHERE feature = 'st1' AND bc.label = p.label) END) AS st1"]) +
    " FROM order_profile p")(fill_class_mode)


# --------------------------------------------------------------- IMP-6..9
GROUPS = {"count_missing": COUNTS, "text_missing": ("st1", "seg")}


def missing_flags(spark, sf):
    df = order_profile(spark, sf)
    out = C.missing_features(df, ALL7, GROUPS)
    out = C.pattern_codes(out, "id")
    flags = [f"{c}_missing" for c in ALL7]
    return out.select("id", *flags, "total_missing", F.round("missing_ratio", 6).alias("missing_ratio"),
                      "missing_bits", "missing_pattern", "missing_pattern_code", *GROUPS)


def _flags_sql():
    fl = [f"CAST({c} IS NULL AS INTEGER)" for c in ALL7]
    total = " + ".join(fl)
    bits = " + ".join(f"{f} * {2 ** i}" for i, f in enumerate(fl))
    pattern = " || ".join(f"CAST({f} AS VARCHAR)" for f in fl)
    groups = [" + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in g) + f" AS {n}" for n, g in GROUPS.items()]
    return with_profile(
        f"b AS (SELECT id, {', '.join(f'{f} AS {c}_missing' for f, c in zip(fl, ALL7))}, {total} AS total_missing, "
        f"{r6(f'({total}) / CAST({float(len(ALL7))!r} AS DOUBLE)')} AS missing_ratio, {bits} AS missing_bits, "
        f"{pattern} AS missing_pattern, {', '.join(groups)} FROM order_profile)",
        "pc AS (SELECT missing_pattern, CAST(dense_rank() OVER (ORDER BY missing_pattern) - 1 AS INTEGER) AS missing_pattern_code "
        "FROM (SELECT DISTINCT missing_pattern FROM b))",
    ) + "SELECT b.*, pc.missing_pattern_code FROM b JOIN pc USING (missing_pattern)"


register("missing_flags", _flags_sql())(missing_flags)


# ----------------------------------------------------------------- IMP-10
def missing_table(spark, sf):
    return C.missing_table(order_profile(spark, sf), ALL7)


register("missing_table", with_profile() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"{r6(f'(count(*) - count({c})) * CAST(100.0 AS DOUBLE) / count(*)')} AS pct_missing FROM order_profile"
    for c in ALL7))(missing_table)


# ----------------------------------------------------------------- IMP-11
def missing_patterns(spark, sf):
    return C.missing_patterns(order_profile(spark, sf), ALL7)


register("missing_patterns", with_profile() + "SELECT " + ", ".join(
    f"CAST({c} IS NULL AS INTEGER) AS {c}_missing" for c in ALL7) +
    ", count(*) AS n FROM order_profile GROUP BY ALL")(missing_patterns)


# ------------------------------------------------------------------ IMP-5
def _knn_sql(k: int = 5) -> tuple[str, ...]:
    """CTEs: distinct recipient patterns × distinct donor vectors (oracle only)."""
    v = [f"v{i}" for i in range(len(COUNTS))]
    p = [f"p{i}" for i in range(len(COUNTS))]
    shared = " + ".join(f"CAST({a} IS NOT NULL AND {b} IS NOT NULL AS INTEGER)" for a, b in zip(p, v))
    ss = " + ".join(f"coalesce(({b} - {a}) * ({b} - {a}), 0)" for a, b in zip(p, v))
    ctes = [
        "ktr AS (SELECT " + ", ".join(f"{c} AS {x}" for c, x in zip(COUNTS, v)) + " FROM order_profile WHERE NOT is_test)",
        "kmean AS (SELECT " + ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(v)) + " FROM ktr)",
        "kdon AS (SELECT " + ", ".join(v) + ", count(*) AS n FROM ktr GROUP BY ALL)",
        "kpat AS (SELECT DISTINCT " + ", ".join(f"{c} AS {x}" for c, x in zip(COUNTS, p)) +
        " FROM order_profile WHERE " + " OR ".join(f"{c} IS NULL" for c in COUNTS) + ")",
        f"kpair AS (SELECT kpat.*, kdon.*, {shared} AS shared, {ss} AS ss FROM kpat, kdon)",
    ]
    order = ", ".join(["dist"] + [f"{x} NULLS LAST" for x in v])
    part = ", ".join(p)
    for j in range(len(COUNTS)):
        ctes.append(
            f"kc{j} AS (SELECT *, sqrt(ss * (CAST({len(COUNTS)} AS DOUBLE) / shared)) AS dist FROM kpair "
            f"WHERE {p[j]} IS NULL AND {v[j]} IS NOT NULL AND shared > 0)")
        ctes.append(
            f"kt{j} AS (SELECT {part}, {v[j]} AS val, least(n, greatest({k} - coalesce(sum(n) OVER "
            f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take "
            f"FROM kc{j})")
        ctes.append(f"ki{j} AS (SELECT {part}, sum(take * val) / sum(take) AS imp FROM kt{j} GROUP BY ALL)")
    return tuple(ctes)


def _knn_select(extra_cols=""):
    joins = []
    sels = []
    for j, c in enumerate(COUNTS):
        cond = " AND ".join(f"ki{j}.p{i} IS NOT DISTINCT FROM o.{cc}" for i, cc in enumerate(COUNTS))
        joins.append(f"LEFT JOIN ki{j} ON {cond}")
        sels.append(f"{r6(f'coalesce(o.{c}, ki{j}.imp, kmean.m{j})')} AS {c}")
    return sels, joins


def fill_knn(spark, sf):
    from sparkfeat.operators.knn import KnnImputer
    df = order_profile(spark, sf)
    knn = KnnImputer(COUNTS, k=5).fit(train_rows(df))
    out = knn.transform(df, "id")
    return out.select("id", *[F.round(c, 6).alias(c) for c in COUNTS])


_ks, _kj = _knn_select()
register("fill_knn", with_profile(*_knn_sql()) + "SELECT o.id, " + ", ".join(_ks) +
         " FROM order_profile o CROSS JOIN kmean " + " ".join(_kj))(fill_knn)


# ------------------------------------------------------------------ IMP-12
def fill_orchestrated(spark, sf):
    from sparkfeat.operators.knn import orchestrated_fill
    df = order_profile(spark, sf)
    out = orchestrated_fill(train_rows(df), df, "id", "label", "is_test", COUNTS, ["st1"],
                            ["qty_r", "max_price"], k=5)
    return out.select("id", *[F.round(c, 6).alias(c) for c in COUNTS], "st1", "qty_r", "max_price")


register("fill_orchestrated", with_profile(
    *_knn_sql(),
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    "cc AS (SELECT label, st1 AS v, count(*) AS n FROM tr WHERE st1 IS NOT NULL GROUP BY label, st1)",
    "bc AS (SELECT label, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, v) AS rk FROM cc) WHERE rk = 1)",
    "ac AS (SELECT v FROM (SELECT v, row_number() OVER (ORDER BY sum(n) DESC, v) AS rk FROM cc GROUP BY v) WHERE rk = 1)",
) + "SELECT o.id, " + ", ".join(_ks) +
    ", coalesce(o.st1, CASE WHEN o.is_test THEN (SELECT v FROM ac) ELSE (SELECT v FROM bc WHERE bc.label = o.label) END) AS st1"
    ", coalesce(o.qty_r, 0) AS qty_r, coalesce(o.max_price, 0) AS max_price"
    " FROM order_profile o CROSS JOIN kmean " + " ".join(_kj))(fill_orchestrated)
