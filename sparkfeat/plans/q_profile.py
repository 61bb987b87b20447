"""Queries for profiling and statistics (AGG-*, SRT-1)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.operators import profile as P
from sparkfeat.plans.sqlkit import r6, with_profile
from sparkfeat.sources.fixtures import ORDER_SPEC, order_profile, train_rows
from sparkfeat.sources.tables import read_table

NUMS = ORDER_SPEC.numeric
CATS = ORDER_SPEC.categorical
COUNTS = ("cnt_r", "cnt_a", "cnt_n")


def _long_sql(cols, keep="", table="order_profile"):
    k = f"{keep}, " if keep else ""
    return "\nUNION ALL\n".join(
        f"SELECT {k}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table} WHERE {c} IS NOT NULL"
        for c in cols)


def _rnd(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ------------------------------------------------------------------ AGG-1
def describe_num(spark, sf):
    out = P.describe_numeric(order_profile(spark, sf), NUMS)
    return _rnd(out, ["mean", "std", "q25", "q50", "q75"])


register("describe_num", with_profile() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, count({c}) AS count, {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {r6(f'quantile_cont({c}, 0.25)')} AS q25, "
    f"{r6(f'quantile_cont({c}, 0.5)')} AS q50, {r6(f'quantile_cont({c}, 0.75)')} AS q75 FROM order_profile"
    for c in NUMS))(describe_num)


# ------------------------------------------------------------------ AGG-2
def describe_cat(spark, sf):
    return P.describe_categorical(order_profile(spark, sf), CATS)


register("describe_cat", with_profile(
    "cnt AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, {c} AS value, count(*) AS n FROM order_profile WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in CATS) + ")",
) + "SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, arg_min(value, (-n, value)) AS top, "
    "max(n) AS freq FROM cnt GROUP BY feature")(describe_cat)


# ------------------------------------------------------------------ AGG-3
def value_share(spark, sf):
    out = P.value_counts(order_profile(spark, sf), CATS + COUNTS)
    return _rnd(out, ["share"])


register("value_share", with_profile() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n, "
    f"{r6('count(*) / CAST((SELECT count(*) FROM order_profile) AS DOUBLE)')} AS share "
    f"FROM order_profile GROUP BY {c}" for c in CATS + COUNTS))(value_share)


# ------------------------------------------------------------------ AGG-4
DUP_COLS = ("cnt_r", "cnt_a", "cnt_n", "pri", "seg", "st1", "label")


def dup_report(spark, sf):
    return P.duplicate_report(order_profile(spark, sf), "id", DUP_COLS)


register("dup_report", with_profile() + """
SELECT 'n_rows' AS metric, count(*) AS value FROM order_profile
UNION ALL SELECT 'dup_ids', count(*) - count(DISTINCT id) FROM order_profile
UNION ALL SELECT 'id_min', min(id) FROM order_profile
UNION ALL SELECT 'id_max', max(id) FROM order_profile
UNION ALL SELECT 'dup_rows', CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM order_profile GROUP BY """ +
    ", ".join(DUP_COLS) + ")")(dup_report)


# ------------------------------------------------------------------ AGG-5
def crosstab(spark, sf):
    out = P.crosstab_share(train_rows(order_profile(spark, sf)), "pri", "label", [0, 1])
    return _rnd(out, ["share_0", "share_1"])


register("crosstab", with_profile() +
         f"SELECT pri, count(*) AS n, {r6('count_if(label = 0) / CAST(count(*) AS DOUBLE)')} AS share_0, "
         f"{r6('count_if(label = 1) / CAST(count(*) AS DOUBLE)')} AS share_1 "
         "FROM order_profile WHERE NOT is_test GROUP BY pri")(crosstab)


# ------------------------------------------------------------------ AGG-6/7
def outlier_sigma(spark, sf):
    out = P.outlier_report(train_rows(order_profile(spark, sf)), NUMS, "label")
    return _rnd(out, ["rate", "base_rate", "lift"])


register("outlier_sigma", with_profile(
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    "mo AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMS) +
    ", avg(label) AS base_rate FROM tr)") + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST(count_if(abs(({c} - m_{c}) / s_{c}) > 2) AS BIGINT) AS out2, "
    f"CAST(count_if(abs(({c} - m_{c}) / s_{c}) > 3) AS BIGINT) AS out3, CAST(count_if(({c} - m_{c}) / s_{c} > 2) AS BIGINT) AS high, "
    f"{r6(f'avg(CASE WHEN ({c} - m_{c}) / s_{c} > 2 THEN label END)')} AS rate, {r6('any_value(base_rate)')} AS base_rate, "
    f"{r6(f'avg(CASE WHEN ({c} - m_{c}) / s_{c} > 2 THEN label END) / any_value(base_rate)')} AS lift "
    "FROM tr, mo" for c in NUMS))(outlier_sigma)


# ------------------------------------------------------------------ AGG-8..10
CORR_COLS = NUMS + ("label",)


def corr_pairs(spark, sf):
    out = P.corr_long(order_profile(spark, sf), CORR_COLS)
    return _rnd(out, ["corr"])


register("corr_pairs", with_profile() + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {r6(f'corr({a}, {b})')} AS corr, "
    f"coalesce(abs(corr({a}, {b})) > 0.9, false) AS high FROM order_profile"
    for a, b in itertools.combinations(CORR_COLS, 2)))(corr_pairs)


# ------------------------------------------------------------------ AGG-11
def ks_drift(spark, sf):
    out = P.ks_two_sample(order_profile(spark, sf), NUMS, "is_test")
    return _rnd(out, ["d", "p_value"])


register("ks_drift", with_profile(
    f"lng AS ({_long_sql(NUMS, 'is_test')})",
    "cnt AS (SELECT feature, value, count_if(NOT is_test) AS na, count_if(is_test) AS nb FROM lng GROUP BY ALL)",
    "cum AS (SELECT feature, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY feature) AS ta, "
    "sum(nb) OVER (PARTITION BY feature) AS tb FROM cnt "
    "WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
    "d AS (SELECT feature, CAST(max(ta) AS BIGINT) AS n_a, CAST(max(tb) AS BIGINT) AS n_b, max(abs(ca / ta - cb / tb)) AS d "
    "FROM cum GROUP BY feature)",
    "lam AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) * d AS lam FROM d)",
    "ser AS (SELECT feature, sum(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * lam * lam)) AS s "
    "FROM lam, range(1, 101) t(j) GROUP BY feature)",
) + f"SELECT lam.feature, n_a, n_b, {r6('d')} AS d, "
    f"{r6('CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2.0 * s, 0.0), 1.0) END')} AS p_value "
    "FROM lam JOIN ser USING (feature)")(ks_drift)


def ks_exact(spark, sf):
    """Does a component of the embeddings spread like the first one? Two samples of equal size,
    for which the exact p-value has a closed form (beyond 10,000 vectors: asymptotic)."""
    e = read_table(spark, sf, "embeddings").select("embedding")
    first = e.select(*[F.col("embedding")[0].cast("double").alias(f"x{j}") for j in range(1, 8)], F.lit(False).alias("other"))
    other = e.select(*[F.col("embedding")[j].cast("double").alias(f"x{j}") for j in range(1, 8)], F.lit(True).alias("other"))
    return _rnd(P.ks_two_sample(first.unionByName(other), [f"x{j}" for j in range(1, 8)], "other", exact_up_to=P.EXACT_KS), ["d", "p_value"])


register("ks_exact", """
WITH x AS (
  SELECT 'x' || j AS feature, embedding[1]::DOUBLE AS value, 1 AS a, 0 AS b FROM embeddings, range(1, 8) t(j)
  UNION ALL SELECT 'x' || j, embedding[j + 1]::DOUBLE, 0, 1 FROM embeddings, range(1, 8) t(j)
), c AS (
  SELECT feature, sum(sum(a)) OVER w AS ca, sum(sum(b)) OVER w AS cb, sum(sum(a)) OVER (PARTITION BY feature) AS n
  FROM x WHERE value IS NOT NULL GROUP BY feature, value WINDOW w AS (PARTITION BY feature ORDER BY value)
), d AS (SELECT feature, any_value(n)::BIGINT AS n, max(abs(ca - cb))::BIGINT AS h FROM c GROUP BY feature),
k AS (
  SELECT feature, n, h, unnest(range(1, greatest(n // greatest(h, 1), 100) + 1)) AS k FROM d
), p AS (
  SELECT feature, n, h,
         2 * sum(CASE WHEN k * h <= n THEN (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
                 * exp(2 * lgamma(n + 1.0) - lgamma(n - least(k * h, n) + 1.0) - lgamma(n + k * h + 1.0)) ELSE 0 END) AS closed,
         2 * sum(CASE WHEN k <= 100 THEN (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * (n / 2.0) * (h / n) * (h / n)) ELSE 0 END) AS series
  FROM k GROUP BY feature, n, h
)
SELECT feature, n AS n_a, n AS n_b, round(h / n::DOUBLE, 6) AS d,
       round(least(greatest(CASE WHEN h = 0 THEN 1 WHEN n <= 10000 THEN closed WHEN sqrt(n / 2.0) * h / n < 0.2 THEN 1 ELSE series END, 0), 1), 6) AS p_value
FROM p""")(ks_exact)


# ------------------------------------------------------------------ AGG-12
def histogram(spark, sf):
    return P.histogram(order_profile(spark, sf), NUMS, ["is_test", "label"], 30)


register("histogram", with_profile(
    "mm AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMS) + " FROM order_profile)",
) + "SELECT feature, is_test, label, bin, count(*) AS n FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, is_test, label, CAST(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 30.0), 29) AS INTEGER) AS bin "
    f"FROM order_profile, mm WHERE {c} IS NOT NULL" for c in NUMS) + ") GROUP BY ALL")(histogram)


# ------------------------------------------------------------------ AGG-13
def five_number(spark, sf):
    out = P.five_number(train_rows(order_profile(spark, sf)), NUMS, "label")
    return _rnd(out, ["q25", "q50", "q75", "lower_fence", "upper_fence"])


register("five_number", with_profile(
    f"lng AS ({_long_sql(NUMS, 'label', '(SELECT * FROM order_profile WHERE NOT is_test)')})",
    "q AS (SELECT feature, CAST(label AS VARCHAR) AS grp, min(value) AS min, max(value) AS max, "
    "quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 "
    "FROM lng GROUP BY feature, label)",
) + f"SELECT feature, grp, min, max, {r6('q25')} AS q25, {r6('q50')} AS q50, {r6('q75')} AS q75, "
    f"{r6('q25 - 1.5 * (q75 - q25)')} AS lower_fence, {r6('q75 + 1.5 * (q75 - q25)')} AS upper_fence FROM q")(five_number)


# ------------------------------------------------------------------ AGG-14
FAMILY = ("cnt_r", "cnt_a", "cnt_n")


def family_stats(spark, sf):
    df = order_profile(spark, sf).fillna(0.0, subset=list(FAMILY))
    return _rnd(P.family_stats(df, FAMILY), ["zero_share", "mean", "std"])


register("family_stats", with_profile() + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {r6(f'avg(CAST(coalesce({c}, 0) = 0 AS DOUBLE))')} AS zero_share, "
    f"{r6(f'avg(coalesce({c}, 0))')} AS mean, {r6(f'stddev_samp(coalesce({c}, 0))')} AS std, "
    f"max(coalesce({c}, 0)) AS max FROM order_profile" for c in FAMILY))(family_stats)


# ------------------------------------------------------------------ AGG-15
def quality_report(spark, sf):
    df = order_profile(spark, sf)
    schema_cols = [f.name for f in df.schema.fields]
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    row = df.agg(F.count("*").alias("n_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in schema_cols])
    miss = sum((F.when(F.col(f"na_{c}") > 0, 1).otherwise(0) for c in schema_cols), F.lit(0))
    m = row.select(F.col("n_rows").cast("double").alias("n_rows"),
                   miss.cast("double").alias("missing_columns"),
                   F.lit(float(len(strings))).alias("string_columns"),
                   F.lit(float(len(schema_cols))).alias("columns"))
    dup = P.duplicate_report(df, "id", DUP_COLS).filter(F.col("metric") == "dup_rows").select(
        "metric", F.col("value").cast("double").alias("value"))
    return m.unpivot([], ["n_rows", "missing_columns", "string_columns", "columns"], "metric", "value") \
        .unionByName(dup)


_Q_COLS = ("id", "cnt_r", "cnt_a", "cnt_n", "qty_r", "max_price", "total", "pri", "seg", "st1", "label", "is_test")
register("quality_report", with_profile() + "SELECT 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM order_profile "
         "UNION ALL SELECT 'missing_columns', CAST(" + " + ".join(
             f"CAST(count_if({c} IS NULL) > 0 AS INTEGER)" for c in _Q_COLS) + " AS DOUBLE) FROM order_profile "
         "UNION ALL SELECT 'string_columns', CAST(3 AS DOUBLE) UNION ALL SELECT 'columns', CAST(12 AS DOUBLE) "
         "UNION ALL SELECT 'dup_rows', CAST(sum(k - 1) AS DOUBLE) FROM (SELECT count(*) AS k FROM order_profile GROUP BY " +
         ", ".join(DUP_COLS) + ")")(quality_report)


# ------------------------------------------------------------------ AGG-18
RULES = {"high_corr_pairs": (">", 10), "max_missing_share": (">", 0.3),
         "zero_heavy_share": (">", 0.3), "constant_columns": (">", 0)}


def diagnose(spark, sf):
    df = order_profile(spark, sf)
    corr = P.corr_long(df, NUMS)
    n_high = corr.agg(F.count_if("high").cast("double").alias("value")).select(
        F.lit("high_corr_pairs").alias("metric"), "value")
    miss = df.agg(F.greatest(*[F.avg(F.col(c).isNull().cast("double")) for c in NUMS]).alias("value")).select(
        F.lit("max_missing_share").alias("metric"), "value")
    fam = P.family_stats(df.fillna(0.0, subset=list(FAMILY)), FAMILY)
    zero = fam.agg(F.avg((F.col("zero_share") > 0.8).cast("double")).alias("value")).select(
        F.lit("zero_heavy_share").alias("metric"), "value")
    const = df.agg(sum((F.when(F.stddev_samp(c) == 0, 1).otherwise(0) for c in NUMS), F.lit(0))
                   .cast("double").alias("value")).select(F.lit("constant_columns").alias("metric"), "value")
    metrics = n_high.unionByName(miss).unionByName(zero).unionByName(const)
    return _rnd(P.flag_rules(metrics, RULES), ["value"])


_DIAG_METRICS = "\nUNION ALL ".join([
    "SELECT 'high_corr_pairs' AS metric, CAST(" + " + ".join(
        f"CAST(coalesce(abs(corr({a}, {b})) > 0.9, false) AS INTEGER)" for a, b in itertools.combinations(NUMS, 2)) +
    " AS DOUBLE) AS value, CAST(10 AS DOUBLE) AS threshold FROM order_profile",
    "SELECT 'max_missing_share', greatest(" + ", ".join(f"avg(CAST({c} IS NULL AS DOUBLE))" for c in NUMS) +
    "), CAST(0.3 AS DOUBLE) FROM order_profile",
    "SELECT 'zero_heavy_share', (" + " + ".join(
        f"CAST(avg(CAST(coalesce({c}, 0) = 0 AS DOUBLE)) > 0.8 AS DOUBLE)" for c in FAMILY) +
    f") / CAST({len(FAMILY)} AS DOUBLE), CAST(0.3 AS DOUBLE) FROM order_profile",
    "SELECT 'constant_columns', CAST(" + " + ".join(
        f"CAST(coalesce(stddev_samp({c}) = 0, false) AS INTEGER)" for c in NUMS) +
    " AS DOUBLE), CAST(0 AS DOUBLE) FROM order_profile",
])
register("diagnose", with_profile(f"m AS ({_DIAG_METRICS})") +
         f"SELECT metric, {r6('value')} AS value, threshold, coalesce(value > threshold, false) AS issue FROM m")(diagnose)


# ------------------------------------------------------------------ SRT-1
def top_k(spark, sf):
    df = order_profile(spark, sf).select("id", "total")
    top = df.orderBy(F.desc("total"), F.asc("id")).limit(10).withColumn("side", F.lit("top"))
    bottom = df.orderBy(F.asc("total"), F.asc("id")).limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


register("top_k", with_profile() +
         "(SELECT id, total, 'top' AS side FROM order_profile ORDER BY total DESC, id LIMIT 10) UNION ALL "
         "(SELECT id, total, 'bottom' AS side FROM order_profile ORDER BY total ASC, id LIMIT 10)")(top_k)


# ------------------------------------------------------------------ AGG-12 density
def density(spark, sf):
    df = train_rows(order_profile(spark, sf))
    mm = df.agg(*[F.min(c).alias(f"lo_{c}") for c in NUMS], *[F.max(c).alias(f"hi_{c}") for c in NUMS]).first()
    h = P.histogram(df, NUMS, ["label"], 30)
    bounds = spark.createDataFrame([(c, float(mm[f"lo_{c}"]), float(mm[f"hi_{c}"]), 30) for c in NUMS],
                                   "feature string, lo double, hi double, bins int")
    h = h.join(F.broadcast(bounds), "feature").withColumn("grp", F.col("label").cast("string")).drop("label")
    out = P.density_grid(h, 31)
    return out.select("feature", "grp", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


register("density", with_profile(
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    "mm AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMS) + " FROM tr)",
    "h AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST(label AS VARCHAR) AS grp, CAST(lo_{c} AS DOUBLE) AS lo, CAST(hi_{c} AS DOUBLE) AS hi, "
        f"CAST(least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 30.0), 29) AS INTEGER) AS bin FROM tr, mm WHERE {c} IS NOT NULL"
        for c in NUMS) + ")",
    "hb AS (SELECT feature, grp, lo, hi, bin, count(*) AS n, lo + (bin + 0.5) * ((hi - lo) / 30) AS c FROM h GROUP BY ALL)",
    "st AS (SELECT feature, grp, lo, hi, sum(n) AS nt, sum(n * c) / sum(n) AS m FROM hb GROUP BY ALL)",
    "v AS (SELECT feature, grp, sum(hb.n * (hb.c - st.m) * (hb.c - st.m)) AS ssd "
    "FROM st JOIN hb USING (feature, grp) GROUP BY feature, grp)",
    "st2 AS (SELECT st.*, 1.06 * sqrt(v.ssd / st.nt) * pow(st.nt, -0.2) AS bw FROM st JOIN v USING (feature, grp))",
    "g AS (SELECT st2.*, p AS point, lo + p * ((hi - lo) / 30) AS x FROM st2, range(0, 31) t(p))",
) + f"SELECT g.feature, g.grp, CAST(g.point AS INTEGER) AS point, {r6('g.x')} AS x, "
    "round(sum(hb.n * exp(-0.5 * pow((g.x - hb.c) / g.bw, 2))) / (g.nt * g.bw * sqrt(2 * pi())), 9) AS density "
    "FROM g JOIN hb USING (feature, grp) GROUP BY g.feature, g.grp, g.point, g.x, g.nt, g.bw")(density)


# ------------------------------------------------------------------ AGG-9 summary
def corr_summary(spark, sf):
    """Count of |r| > 0.9 pairs and the mean |r| over all pairs (lower triangle)."""
    pairs = P.corr_long(order_profile(spark, sf), CORR_COLS)
    return pairs.agg(F.count_if("high").alias("n_high"),
                     F.round(F.avg(F.abs("corr")), 6).alias("mean_abs_corr"),
                     F.count("corr").alias("n_pairs"))


register("corr_summary", with_profile(
    "pr AS (" + "\nUNION ALL\n".join(
        f"SELECT corr({a}, {b}) AS r FROM order_profile" for a, b in itertools.combinations(CORR_COLS, 2)) + ")",
) + f"SELECT CAST(count_if(abs(r) > 0.9) AS BIGINT) AS n_high, {r6('avg(abs(r))')} AS mean_abs_corr, count(r) AS n_pairs FROM pr")(corr_summary)


# ------------------------------------------------------------------ AGG-18 (reference rule set)
REF_RULES = {"high_corr_pairs": (">", 10), "tfidf_zero_ratio": (">", 0.8), "ngram_unique_ratio": (">", 0.95)}


def diagnose_rules(spark, sf):
    """Multicollinearity (> 10 pairs with |r| > 0.9), TF-IDF sparsity (zero
    share of the dense TF-IDF cells > 0.8) and n-gram cardinality (distinct
    share of an n-gram column > 0.95), as issue flags."""
    from sparkfeat.operators import text as T
    from sparkfeat.plans import q_text
    df = order_profile(spark, sf)
    n_high = P.corr_long(df, NUMS).agg(F.count_if("high").cast("double").alias("value"))
    docs, w, vocab = q_text._gram_tfidf(spark, sf)
    dense = T.dense_top_terms(docs, w, vocab, "id", 5)
    cells = [c for c in dense.columns if c != "id"]
    zero = dense.agg((sum((F.count_if(F.col(c) == 0) for c in cells), F.lit(0)) /
                      (F.count("*") * F.lit(float(len(cells))))).alias("value"))
    uniq = T.low_info_report(docs, list(q_text.GRAM_GROUPS), []).agg(F.max("stat").alias("value"))
    metrics = (n_high.select(F.lit("high_corr_pairs").alias("metric"), "value")
               .unionByName(zero.select(F.lit("tfidf_zero_ratio").alias("metric"), "value"))
               .unionByName(uniq.select(F.lit("ngram_unique_ratio").alias("metric"), "value")))
    return _rnd(P.flag_rules(metrics, REF_RULES), ["value"])


def _diag_rules_sql():
    from sparkfeat.plans import q_text
    dense = q_text._dense_sql()
    slots = [f"{k}_t{i}" for k in sorted(q_text.GRAM_GROUPS) for i in range(1, 6)]
    zero = " + ".join(f"count_if({c} = 0)" for c in slots)
    grams = ", ".join(f"concat_ws('_', {', '.join(g)}) AS {k}" for k, g in q_text.GRAM_GROUPS.items())
    uniq = "greatest(" + ", ".join(f"count(DISTINCT {k}) / CAST(count(*) AS DOUBLE)" for k in q_text.GRAM_GROUPS) + ")"
    pairs = " + ".join(f"CAST(coalesce(abs(corr({a}, {b})) > 0.9, false) AS INTEGER)"
                       for a, b in itertools.combinations(NUMS, 2))
    return with_profile(
        q_text._BASE_SQL,
        f"dn AS ({dense})",
        f"m AS (SELECT 'high_corr_pairs' AS metric, CAST({pairs} AS DOUBLE) AS value, CAST(10 AS DOUBLE) AS threshold "
        "FROM order_profile "
        f"UNION ALL SELECT 'tfidf_zero_ratio', ({zero}) / (count(*) * CAST({len(slots)} AS DOUBLE)), "
        "CAST(0.8 AS DOUBLE) FROM dn "
        f"UNION ALL SELECT 'ngram_unique_ratio', {uniq}, CAST(0.95 AS DOUBLE) FROM (SELECT {grams} FROM base))",
    ) + f"SELECT metric, {r6('value')} AS value, threshold, coalesce(value > threshold, false) AS issue FROM m"


register("diagnose_rules", _diag_rules_sql())(diagnose_rules)
