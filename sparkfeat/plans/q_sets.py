"""Queries for scans, sinks, lookups, row sets and sampling (SRC, SNK, JOI, SET, SMP)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfeat.catalog import register
from sparkfeat.functions.hashing import sql_hash32
from sparkfeat.operators import sets as S
from sparkfeat.operators.encode import apply_codes, fit_codes
from sparkfeat.plans.sqlkit import with_profile
from sparkfeat.session import checkpoint_dir
from sparkfeat.sources import sinks
from sparkfeat.sources.fixtures import order_profile
from sparkfeat.sources.tables import read_csv, read_split, read_table


def _scratch(spark, name):
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sparkfeat-tables/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------- SNK-1 + SRC-3
def feature_table_roundtrip(spark, sf):
    df = order_profile(spark, sf).withColumn("is_pseudo", F.col("is_test"))
    path = _scratch(spark, "features")
    sinks.write_features(df.select("id", "cnt_r", "qty_r", "pri", "label", "is_pseudo"), path,
                         partition_by=["is_pseudo"])
    return read_split(spark, path, "is_pseudo", keep_pseudo=False).select("id", "cnt_r", "qty_r", "pri", "label")


register("feature_table_roundtrip", with_profile() +
         "SELECT id, cnt_r, qty_r, pri, label FROM order_profile WHERE NOT is_test")(feature_table_roundtrip)


# ------------------------------------------------------- SNK-1 csv + SRC-1
CSV_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("cnt_a", T.DoubleType()),
                           T.StructField("seg", T.StringType()), T.StructField("label", T.IntegerType())])


def csv_roundtrip(spark, sf):
    df = order_profile(spark, sf).select("id", "cnt_a", "seg", "label")
    path = _scratch(spark, "csv")
    sinks.write_features(df, path, fmt="csv")
    return read_csv(spark, path, CSV_SCHEMA)


register("csv_roundtrip", with_profile() + "SELECT id, cnt_a, seg, label FROM order_profile")(csv_roundtrip)


# ------------------------------------------------------------------ JOI-1
def lookup_default(spark, sf):
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf, "nation")
    region = read_table(spark, sf, "region")
    out = S.lookup_with_default(cust, nation, "c_nationkey", "n_nationkey", "n_name", "unknown", "c_custkey")
    out = S.lookup_with_default(out, nation, "c_nationkey", "n_nationkey", "n_regionkey", -1, "c_custkey")
    out = S.lookup_with_default(out, region, "n_regionkey", "r_regionkey", "r_name", "unknown", "c_custkey")
    return out.select("c_custkey", "n_name", "r_name")


register("lookup_default",
         "SELECT c.c_custkey, coalesce(n.n_name, 'unknown') AS n_name, coalesce(r.r_name, 'unknown') AS r_name "
         "FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey "
         "LEFT JOIN region r ON coalesce(n.n_regionkey, -1) = r.r_regionkey")(lookup_default)


def lookup_key_types(spark, sf):
    """Order keys, moved beyond the int range, looked up in tables of int, double and string keys
    with 32 and with 33 rows: unknown keys take the default, on either way of looking up."""
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, F.lit(0)).otherwise(F.lit(2 ** 40))).alias("k"))
    out = orders
    for size in (32, 33):
        for kind in ("int", "double", "string"):
            table = (read_table(spark, sf, "orders").where(F.col("o_orderkey") < 1000).select(F.col("o_orderkey").alias("t"))
                     .orderBy("t").limit(size).select(F.col("t").cast(kind).alias("t"), F.col("t").cast("long").alias("v")))
            out = S.lookup_with_default(out, table, "k", "t", "v", -1, "o_orderkey", out=f"{kind}_{size}")
    return out.drop("k")


register("lookup_key_types",
         "WITH t AS (SELECT o_orderkey AS t, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey < 1000), "
         "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1099511627776 END AS k FROM orders) "
         "SELECT o_orderkey, " + ", ".join(f"CASE WHEN r <= {n} THEN t ELSE -1 END::BIGINT AS {kind}_{n}"
                                           for n in (32, 33) for kind in ("int", "double", "string")) +
         " FROM o LEFT JOIN t ON o.k = t.t")(lookup_key_types)


# ------------------------------------------------------------------ JOI-2/3
def concat_by_id(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    return S.concat_by_key(o, li, "id", "inner")


register("concat_by_id",
         "SELECT o.o_orderkey AS id, o.o_totalprice AS total, l.n_lines, l.qty FROM orders o JOIN "
         "(SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) l "
         "ON o.o_orderkey = l.l_orderkey")(concat_by_id)


# ------------------------------------------------------------------ SET-1
def append_rows(spark, sf):
    df = order_profile(spark, sf)
    train = df.filter(~F.col("is_test")).select("id", "label")
    pseudo = df.filter(F.col("is_test")).select(
        "id", (F.col("total") > 250000.0).cast("int").alias("label"),
        F.lit(0.8).alias("weight"), F.lit(True).alias("is_pseudo"))
    out = S.append_rows(train, pseudo)  # absent weight stays missing
    return out.withColumn("is_pseudo", F.coalesce("is_pseudo", F.lit(False)))


register("append_rows", with_profile() +
         "SELECT id, label, CAST(NULL AS DOUBLE) AS weight, false AS is_pseudo FROM order_profile "
         "WHERE NOT is_test UNION ALL SELECT id, CAST(total > 250000.0 AS INTEGER), CAST(0.8 AS DOUBLE), true "
         "FROM order_profile WHERE is_test")(append_rows)


# ------------------------------------------------------------------ SET-2
def union_split(spark, sf):
    df = order_profile(spark, sf)
    both = S.union_split(df.filter(~F.col("is_test")).select("id", "pri"),
                         df.filter(F.col("is_test")).select("id", "pri"))
    st = fit_codes(both, ["pri"], "nan")
    return apply_codes(both, st, ["pri"], "id").select("id", "split", "pri_code")


register("union_split", with_profile(
    "u AS (SELECT id, pri, 'train' AS split FROM order_profile WHERE NOT is_test UNION ALL "
    "SELECT id, pri, 'test' FROM order_profile WHERE is_test)",
    "cd AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
    "(SELECT DISTINCT coalesce(pri, 'nan') AS v FROM u))",
) + "SELECT id, split, code AS pri_code FROM u JOIN cd ON coalesce(u.pri, 'nan') = cd.v")(union_split)


# ------------------------------------------------------------------ SET-3 / SRC-2
def union_distinct(spark, sf):
    li = read_table(spark, sf, "lineitem")
    a = li.filter(F.col("l_linenumber") <= 3).select("l_orderkey", "l_returnflag")
    b = li.filter(F.col("l_linenumber") >= 2).select("l_orderkey", "l_returnflag")
    return S.union_distinct(a, b)


register("union_distinct",
         "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber <= 3 UNION "
         "SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber >= 2")(union_distinct)


# ------------------------------------------------------------------ SET-4
def id_overlap(spark, sf):
    cust = read_table(spark, sf, "customer")
    orders = read_table(spark, sf, "orders")
    return S.id_overlap(cust, orders, "c_custkey", "o_custkey")


register("id_overlap", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")(id_overlap)


# ------------------------------------------------------------------ SMP-1
def sample_rows(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return S.sample_n(o, "id", 500, 42)


register("sample_rows",
         f"SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY {sql_hash32('o_orderkey', 42, 'sample')}, "
         "o_orderkey LIMIT 500")(sample_rows)


# ------------------------------------------------------------------ SMP-2
def holdout_split(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return S.holdout_split(o, "id", 20, 42)


register("holdout_split",
         f"SELECT o_orderkey AS id, {sql_hash32('o_orderkey', 42, 'split')} % 100 < 20 AS is_valid FROM orders")(holdout_split)


# ------------------------------------------------------------------ SNK-2 / SNK-3
def metrics_roundtrip(spark, sf):
    """Store the CV metrics as JSON, then compare a second variant against them."""
    from sparkfeat.operators import ensemble as EN
    from sparkfeat.sources.fixtures import scored
    s = scored(spark, sf).filter(~F.col("is_test"))

    def metrics(threshold):
        cv = EN.cv_summary(s, threshold)
        return cv.select(F.concat(F.lit("mean_acc_"), "model").alias("metric"),
                         F.round("mean_acc", 6).alias("value"))

    path = _scratch(spark, "metrics")
    sinks.write_metrics(metrics(0.5), path)
    out = sinks.compare_metrics(spark, metrics(0.6), path)
    return out.select("metric", "value", "old_value", F.round("delta", 6).alias("delta"))


def _metrics_sql():
    from sparkfeat.sources.fixtures import scored_sql
    from sparkfeat.plans.sqlkit import r6

    def cv(t, name):
        return (f"{name} AS (SELECT 'mean_acc_' || model AS metric, {r6('avg(acc)')} AS value FROM "
                f"(SELECT model, fold, avg(CAST(CAST(p > {t} AS INTEGER) = label AS DOUBLE)) AS acc FROM scored "
                f"WHERE NOT is_test GROUP BY model, fold) GROUP BY model)")
    return ("WITH " + scored_sql().strip() + ",\n" + cv(0.5, "old") + ",\n" + cv(0.6, "new") +
            f"\nSELECT new.metric, new.value, old.value AS old_value, {r6('new.value - old.value')} AS delta "
            "FROM new LEFT JOIN old USING (metric)")


register("metrics_roundtrip", _metrics_sql())(metrics_roundtrip)
