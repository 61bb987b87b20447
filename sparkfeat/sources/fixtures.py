"""Feature tables derived from the driver tables (FIXTURES.md §3).

Each profile is a DataFrame built only from the given tables, so its size
grows with them. The SQL twins (DuckDB dialect) are used as oracle CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.functions.hashing import hash32, sql_hash32, TWO32
from sparkfeat.sources.tables import read_table
from sparkfeat.spec import FeatureSpec

ORDER_SPEC = FeatureSpec(
    id="id", label="label", split="is_test",
    numeric=("cnt_r", "cnt_a", "cnt_n", "qty_r", "max_price", "total"),
    categorical=("pri", "seg", "st1"),
)

# Small-integer columns: the "survey count" part of the order profile. They are
# doubles, as numeric survey columns with gaps are (FIXTURES.md §1).
COUNT_COLS = ("cnt_r", "cnt_a", "cnt_n")


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: line counts by return flag, gaps, priority, segment."""
    li = read_table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    per_order = li.groupBy("l_orderkey").agg(
        F.nullif(F.count_if(flag == "R"), F.lit(0)).cast("double").alias("cnt_r"),
        F.nullif(F.count_if(flag == "A"), F.lit(0)).cast("double").alias("cnt_a"),
        F.nullif(F.count_if(flag == "N"), F.lit(0)).cast("double").alias("cnt_n"),
        F.avg(F.when(flag == "R", F.col("l_quantity"))).alias("qty_r"),
        F.max("l_extendedprice").alias("max_price"),
        # single-character status kept as its code point so the aggregate
        # stays a hash aggregate (max over strings forces a sort aggregate)
        F.max(F.when(F.col("l_linenumber") == 1, F.ascii("l_linestatus"))).alias("st1_code"),
    ).withColumn("st1", F.expr("chr(st1_code)")).drop("st1_code")
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
        .join(cust, orders.o_custkey == cust.c_custkey, "left")
        .select(
            F.col("o_orderkey").alias("id"),
            "cnt_r", "cnt_a", "cnt_n", "qty_r", "max_price",
            F.col("o_totalprice").alias("total"),
            F.col("o_orderpriority").alias("pri"),
            F.col("c_mktsegment").alias("seg"),
            "st1",
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("is_test"),
        )
    )


ORDER_PROFILE_SQL = """
order_profile AS (
  SELECT o.o_orderkey AS id, l.cnt_r, l.cnt_a, l.cnt_n, l.qty_r, l.max_price,
         o.o_totalprice AS total, o.o_orderpriority AS pri, c.c_mktsegment AS seg,
         l.st1, CAST(o.o_orderstatus = 'F' AS INTEGER) AS label,
         o.o_orderdate >= TIMESTAMP '2000-01-01' AS is_test
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey,
           CAST(nullif(count_if(l_returnflag = 'R'), 0) AS DOUBLE) AS cnt_r,
           CAST(nullif(count_if(l_returnflag = 'A'), 0) AS DOUBLE) AS cnt_a,
           CAST(nullif(count_if(l_returnflag = 'N'), 0) AS DOUBLE) AS cnt_n,
           avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS qty_r,
           max(l_extendedprice) AS max_price,
           max(CASE WHEN l_linenumber = 1 THEN l_linestatus END) AS st1
    FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""


def train_rows(df: DataFrame, spec: FeatureSpec = ORDER_SPEC) -> DataFrame:
    return df.filter(~F.col(spec.split))


def test_rows(df: DataFrame, spec: FeatureSpec = ORDER_SPEC) -> DataFrame:
    return df.filter(F.col(spec.split))


# ---------------------------------------------------------------- doc_profile
DOC_SPEC = FeatureSpec(
    id="doc_id", label="quality", split="is_test",
    numeric=("n_chars", "n_words", "mean_word_len", "digit_share", "upper_share",
             "distinct_word_share"),
    categorical=("lang", "source"),
)
DOC_FEATURES = DOC_SPEC.numeric


def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: text statistics, language/source, labels if known."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0)
    n_len = F.greatest(F.length("text"), F.lit(1))
    feats = docs.select(
        "doc_id", "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"),
        (F.length(F.regexp_replace("text", r"\s", "")) /
         F.greatest(F.size(words), F.lit(1))).alias("mean_word_len"),
        (F.length(F.regexp_replace("text", "[^0-9]", "")) / n_len).alias("digit_share"),
        (F.length(F.regexp_replace("text", r"\P{Lu}", "")) / n_len).alias("upper_share"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
        .alias("distinct_word_share"),
    )
    return (feats.join(labels, "doc_id", "left")
            .withColumn("is_test", F.col("quality").isNull()))


# --------------------------------------------------------------- scored table
MODELS = ("m1", "m2", "m3", "m4")


def scored(spark: SparkSession, sf_dir: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Long score table (id, model, p, label, fold, is_test) for ensemble checks.

    p mixes the true label with a hash uniform so every model is right about
    three times in four; it stands in for out-of-fold model output.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).alias("is_test"))
    models = F.array(*[F.lit(m) for m in MODELS])
    long = orders.select("*", F.explode(models).alias("model"))
    u = hash32(F.concat_ws("|", F.col("model"), F.col("id").cast("string")), seed, "p") / F.lit(TWO32)
    return long.select(
        "id", "model",
        F.round((F.col("label") * F.lit(0.5) + u) / F.lit(1.5), 6).alias("p"),
        "label",
        F.pmod(hash32("id", seed, "fold"), F.lit(n_folds)).cast("int").alias("fold"),
        "is_test",
    )


def scored_sql(n_folds: int = 5, seed: int = 42) -> str:
    # hash key is seed|p|model|id, exactly as on the Spark side
    u = (f"(cast('0x' || substr(md5(concat_ws('|', '{seed}', 'p', model || '|' || cast(id as varchar))), 1, 8)"
         f" as bigint) / {TWO32!r})")
    return f"""
scored AS (
  SELECT id, model, round((label * 0.5 + {u}) / 1.5, 6) AS p, label,
         CAST({sql_hash32('id', seed, 'fold')} % {n_folds} AS INTEGER) AS fold, is_test
  FROM (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
               o_orderdate >= TIMESTAMP '2000-01-01' AS is_test FROM orders) o,
       (SELECT unnest(['m1','m2','m3','m4']) AS model) m
)"""


# -------------------------------------------------------------- event_profile
def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, event type): count and mean value."""
    ev = read_table(spark, sf_dir, "events")
    return ev.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.avg("value").alias("avg_value"))
