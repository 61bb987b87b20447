"""Queries for combinations, tokens and TF-IDF (TXT-*)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.operators import clean as C
from sparkfeat.operators import text as T
from sparkfeat.functions.rounding import sig6
from sparkfeat.plans.sqlkit import r6, sig6_sql, with_profile
from sparkfeat.session import spread, written
from sparkfeat.sources.fixtures import ORDER_SPEC, order_profile
from sparkfeat.sources.tables import read_table

INTS = ("cnt_r", "cnt_a", "cnt_n", "qty_r")
CATS = ("pri", "seg", "st1")
BASE7 = INTS + CATS

# Fixed column groups (stand-ins for the chosen 2-, 4- and 5-column combinations)
PAIR_GROUPS = (("cnt_a", "qty_r"), ("cnt_n", "seg"), ("cnt_a", "cnt_n"), ("qty_r", "seg"),
               ("cnt_r", "pri"), ("cnt_r", "st1"), ("pri", "st1"), ("cnt_r", "cnt_a"))
GRAM_GROUPS = {"g4a": ("cnt_r", "cnt_a", "cnt_n", "pri"),
               "g4b": ("cnt_a", "qty_r", "seg", "st1"),
               "g5": ("cnt_r", "cnt_a", "cnt_n", "qty_r", "seg")}


def _base(spark, sf):
    df = order_profile(spark, sf)
    return df.select("id", "is_test", *[C.int_string(c).alias(c) for c in INTS],
                     *[C.category_string(c).alias(c) for c in CATS])


_BASE_SQL = "base AS (SELECT id, " + ", ".join(
    [f"CAST(CAST(trunc(coalesce({c}, -1)) AS SMALLINT) AS VARCHAR) AS {c}" for c in INTS] +
    [f"coalesce({c}, 'missing') AS {c}" for c in CATS]) + " FROM order_profile)"


def _name(group):
    return "__".join(group)


# ---------------------------------------------------------------- TXT-1
def combos2(spark, sf):
    b = _base(spark, sf)
    return b.select("id", *[F.concat_ws("-", *g).alias(_name(g)) for g in itertools.combinations(BASE7, 2)])


register("combos2", with_profile(_BASE_SQL) + "SELECT id, " + ", ".join(
    f"concat_ws('-', {', '.join(g)}) AS {_name(g)}" for g in itertools.combinations(BASE7, 2)) +
    " FROM base")(combos2)


# ---------------------------------------------------------------- TXT-2
def combos3(spark, sf):
    b = _base(spark, sf)
    return b.select("id", *[F.concat_ws("-", *g).alias(_name(g)) for g in itertools.combinations(BASE7, 3)])


register("combos3", with_profile(_BASE_SQL) + "SELECT id, " + ", ".join(
    f"concat_ws('-', {', '.join(g)}) AS {_name(g)}" for g in itertools.combinations(BASE7, 3)) +
    " FROM base")(combos3)


# --------------------------------------------------------- TXT-3/4/5
def combos_chosen(spark, sf):
    b = _base(spark, sf)
    pairs = T.chosen_combos(b, PAIR_GROUPS, "_", "_combo")
    grams = {k: F.concat_ws("_", *g) for k, g in GRAM_GROUPS.items()}
    variant = {"cnt_r__cnt_a_cnt_n_v": T.unseparated_triple("cnt_r", "cnt_a", "cnt_n")}
    return b.select("id", *[v.alias(k) for k, v in {**pairs, **grams, **variant}.items()])


register("combos_chosen", with_profile(_BASE_SQL) + "SELECT id, " + ", ".join(
    [f"concat_ws('_', {', '.join(g)}) AS {'_'.join(g)}_combo" for g in PAIR_GROUPS] +
    [f"concat_ws('_', {', '.join(g)}) AS {k}" for k, g in GRAM_GROUPS.items()] +
    ["cnt_r || '-' || cnt_a || cnt_n AS cnt_r__cnt_a_cnt_n_v"]) + " FROM base")(combos_chosen)


# ----------------------------------------------------------- TXT-6/7
def gram_docs(spark, sf):
    b = _base(spark, sf)
    return b.select("id", "is_test", *[F.concat_ws("_", *g).alias(k) for k, g in GRAM_GROUPS.items()])


def _gram_tfidf(spark, sf):
    """Vocabulary and idf from the training rows, weights of all rows."""
    docs = written(gram_docs(spark, sf), "grams")       # joined once, read by the fit and both results
    toks = {k: T.split_tokens(k, "_") for k in GRAM_GROUPS}
    w, vocab = T.tfidf(docs, "id", toks, min_df=2, max_features=100, fit_on=docs.filter("not is_test"))
    return docs.drop("is_test"), w, vocab


def tfidf_combo(spark, sf):
    _, w, _ = _gram_tfidf(spark, sf)
    return w.select("id", "feature", "token", F.round("tfidf", 6).alias("tfidf"))


def _tfidf_sql(docs_cte, max_features, id_col="id", n_sql="SELECT count(*) AS n FROM order_profile",
               tok_expr="unnest(string_split(doc, '_'))", pre=(), keep_feature=True, fit=""):
    top = "" if max_features is None else f" WHERE r <= {max_features}"
    feat_sel = "feature, " if keep_feature else ""
    return with_profile(
        *pre, docs_cte,
        f"toks AS (SELECT {id_col} AS id, feature, {tok_expr} AS token FROM docs)",
        "tf AS (SELECT id, feature, token, count(*) AS tf FROM toks WHERE token <> '' GROUP BY ALL)",
        f"nd AS ({n_sql})",
        "st AS (SELECT feature, token, count(*) AS df, sum(tf) AS total FROM tf" + fit + " GROUP BY ALL)",
        f"voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY total DESC, token) AS r "
        f"FROM st WHERE df >= 2){top})",
        "w AS (SELECT tf.id, tf.feature, tf.token, tf.tf * (ln(CAST(nd.n + 1 AS DOUBLE) / (voc.df + CAST(1 AS DOUBLE))) + 1) AS w "
        "FROM tf JOIN voc USING (feature, token), nd)",
    ) + f"SELECT id AS {id_col}, {feat_sel}token, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY id, feature))')} AS tfidf FROM w"


_GRAM_DOCS = "docs AS (" + "\nUNION ALL\n".join(
    f"SELECT id, '{k}' AS feature, concat_ws('_', {', '.join(g)}) AS doc FROM base"
    for k, g in GRAM_GROUPS.items()) + ")"

_FIT = {"n_sql": "SELECT count(*) AS n FROM order_profile WHERE NOT is_test",
        "fit": " WHERE id IN (SELECT id FROM order_profile WHERE NOT is_test)"}
register("tfidf_combo", _tfidf_sql(_GRAM_DOCS, 100, pre=(_BASE_SQL,), **_FIT))(tfidf_combo)


def tfidf_docs(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    w, _ = T.tfidf(docs, "doc_id", {"text": T.word_tokens("text")}, min_df=2, max_features=None)
    return w.select("doc_id", "token", F.round("tfidf", 6).alias("tfidf"))


register("tfidf_docs", _tfidf_sql(
    "docs AS (SELECT doc_id, 'text' AS feature, text FROM documents)", None, id_col="doc_id",
    n_sql="SELECT count(*) AS n FROM documents",
    tok_expr=r"lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]{2,}')))",
    keep_feature=False))(tfidf_docs)


# ---------------------------------------------------------------- TXT-8
def tfidf_dense(spark, sf):
    docs, w, vocab = _gram_tfidf(spark, sf)
    out = T.dense_top_terms(docs, w, vocab, "id", 5)
    slots = [c for c in out.columns if c != "id"]
    return out.select("id", *[F.round(c, 6).alias(c) for c in slots])


def _dense_sql():
    base = _tfidf_sql(_GRAM_DOCS, 100, pre=(_BASE_SQL,), **_FIT)
    head, _ = base.rsplit("SELECT id AS id", 1)
    sels = ", ".join(
        f"{r6(f'coalesce(max(CASE WHEN x.feature = {chr(39)}{k}{chr(39)} AND x.ar = {i} THEN x.tfidf END), 0.0)')} AS {k}_t{i}"
        for k in sorted(GRAM_GROUPS) for i in range(1, 6))
    return head.rstrip() + """,
wn AS (SELECT id, feature, token, w / sqrt(sum(w * w) OVER (PARTITION BY id, feature)) AS tfidf FROM w),
ar AS (SELECT feature, token, row_number() OVER (PARTITION BY feature ORDER BY token) AS ar FROM voc),
x AS (SELECT wn.id, wn.feature, wn.tfidf, ar.ar FROM wn JOIN ar USING (feature, token) WHERE ar.ar <= 5)
SELECT b.id, """ + sels + " FROM base b LEFT JOIN x ON b.id = x.id GROUP BY b.id"


register("tfidf_dense", _dense_sql())(tfidf_dense)


# ---------------------------------------------------------------- TXT-9
def low_info_filter(spark, sf):
    b = _base(spark, sf)
    p = order_profile(spark, sf)
    docs = b.select("id", *BASE7, *[F.concat_ws("_", *g).alias(k) for k, g in GRAM_GROUPS.items()])
    strings = T.low_info_report(docs, list(BASE7) + list(GRAM_GROUPS), [])
    nums = T.low_info_report(p, [], ORDER_SPEC.numeric)
    out = strings.unionByName(nums)
    return out.select("feature", "kind", sig6("stat").alias("stat"), "kept")


register("low_info_filter", with_profile(
    _BASE_SQL,
    "docs AS (SELECT *, " + ", ".join(f"concat_ws('_', {', '.join(g)}) AS {k}" for k, g in GRAM_GROUPS.items()) +
    " FROM base)") + "\nUNION ALL\n".join(
    [f"SELECT '{c}' AS feature, 'string' AS kind, {sig6_sql(f'count(DISTINCT {c}) / CAST(count(*) AS DOUBLE)')} AS stat, "
     f"count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) > 0.01 AS kept FROM docs" for c in list(BASE7) + list(GRAM_GROUPS)] +
    [f"SELECT '{c}' AS feature, 'numeric' AS kind, {sig6_sql(f'var_samp({c})')} AS stat, "
     f"coalesce(var_samp({c}) > 1e-6, false) AS kept FROM order_profile" for c in ORDER_SPEC.numeric]))(low_info_filter)


# --------------------------------------------------------------- TXT-10
def family_table(spark, sf):
    """Columns of all families: the numbers, chosen 4- and 5-grams and dense TF-IDF terms (tagged by
    the operators that make them), and columns that only their names place."""
    p, b = order_profile(spark, sf), _base(spark, sf)
    grams = T.chosen_combos(b, list(GRAM_GROUPS.values()), "_", "_combo")
    made = b.select("id", *[v.alias(k) for k, v in zip(GRAM_GROUPS, grams.values())])
    docs, w, vocab = _gram_tfidf(spark, sf)
    dense = T.dense_top_terms(docs, w, vocab, "id", 2)
    named = p.select("id", "label", *ORDER_SPEC.numeric, F.sqrt("total").alias("TFIDF_like"), F.col("cnt_r").alias("R_4Gram"),
                     F.col("cnt_a").alias("A_5GRAM"), F.log1p("max_price").alias("log_MAX_PRICE"),
                     F.col("st1").alias("line_state"))
    n = docs.count()        # of files
    named, made, dense = (spread(t, n, "id") for t in (named, made, dense))
    return named.join(made, "id").join(dense, "id")


def feature_families(spark, sf):
    t = family_table(spark, sf).drop("id", "label")
    families = T.feature_families(t, originals=ORDER_SPEC.numeric)
    counts = t.agg(*[F.count(c).alias(c) for c in t.columns]).unpivot([], t.columns, "feature", "n_values")
    return families.join(counts, "feature")


def _families_sql():
    cols = [(c, "Original", False, c) for c in ORDER_SPEC.numeric]
    cols += [("TFIDF_like", "TF-IDF", False, "total"), ("R_4Gram", "4-gram", False, "cnt_r"),
             ("A_5GRAM", "5-gram", False, "cnt_a"), ("log_MAX_PRICE", "Original", False, "max_price"),
             ("line_state", "Other", False, "st1")]
    cols += [(k, f"{len(g)}-gram", True, "id") for k, g in GRAM_GROUPS.items()]
    cols += [(f"{k}_t{i}", "TF-IDF", True, "id") for k in GRAM_GROUPS for i in (1, 2)]
    return with_profile() + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS feature, '{family}' AS family, {str(tag).lower()} AS tagged, count({c}) AS n_values FROM order_profile"
        for name, family, tag, c in cols)


register("feature_families", _families_sql())(feature_families)
