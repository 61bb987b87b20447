"""Queries for encoders and folds (ENC-*, CV-*) on the order profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.catalog import register
from sparkfeat.functions.hashing import sql_gaussian, sql_hash32
from sparkfeat.operators import encode as E
from sparkfeat.operators import folds as CV
from sparkfeat.plans.sqlkit import r6, union_stats, with_profile
from sparkfeat.sources.fixtures import ORDER_SPEC, order_profile, train_rows
from sparkfeat.sources.tables import read_table

CATS = ("pri", "seg", "st1")
NUMS = ORDER_SPEC.numeric
ALPHA = 50.0  # smoothing used by the reference's encoding run
K = 5
SEED = 42


def _r(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _train(spark, sf):
    """Training rows with what the encoders need, so that folds, shuffles and checkpoints carry no more."""
    return train_rows(order_profile(spark, sf)).select("id", "label", "is_test", *CATS)


# ---------------------------------------------------------------- SQL pieces
def _sql_oof(fold_sqls, cols, alpha, names, table="tr", id_sql="id"):
    """CTEs + select list for leave-fold-out encodings over fold expressions."""
    ctes, joins, sels = [], [], []
    a = repr(float(alpha))
    for i, _ in enumerate(fold_sqls):
        f = f"f{i}"
        ctes.append(f"""fg{i} AS (SELECT {f} AS fold, count(*) AS n, sum(label) AS s FROM {table} GROUP BY {f}),
gf{i} AS (SELECT fold, CASE WHEN t.tn - fg{i}.n = 0 THEN NULL ELSE (t.ts - fg{i}.s) / (t.tn - fg{i}.n) END AS g
          FROM fg{i}, (SELECT sum(n) AS tn, sum(s) AS ts FROM fg{i}) t),
st{i} AS ({union_stats(cols, table, "CAST({c} AS VARCHAR) AS value, " + f + " AS fold, count(*) AS n, sum(label) AS s", True, "{c}, " + f)}),
en{i} AS (SELECT feature, value, st.fold,
        CASE WHEN NV - n + {a} = 0 THEN g ELSE (SV - s + {a} * g) / (NV - n + {a}) END AS enc
   FROM (SELECT *, sum(n) OVER (PARTITION BY feature, value) AS NV,
                   sum(s) OVER (PARTITION BY feature, value) AS SV FROM st{i}) st
   JOIN gf{i} USING (fold))""")
        joins.append(f"JOIN gf{i} ON gf{i}.fold = x.{f}")
        for c in cols:
            joins.append(f"LEFT JOIN en{i} e{i}_{c} ON e{i}_{c}.feature = '{c}' AND "
                         f"e{i}_{c}.value = CAST(x.{c} AS VARCHAR) AND e{i}_{c}.fold = x.{f}")
            sels.append((names[(c, i)], f"coalesce(e{i}_{c}.enc, gf{i}.g)"))
    return ctes, joins, sels


def _strat_sql(seed):
    return CV.sql_strat_fold("id", "label", K, seed)


def _hash_sql(seed):
    return CV.sql_hash_fold("id", K, seed)


# ------------------------------------------------------------------ ENC-3
def te_smooth(spark, sf):
    df = order_profile(spark, sf)
    model = E.fit_smooth(train_rows(df), CATS, "label", ALPHA)
    out = model.transform(df, "id")
    return _r(out.select("id", *[f"{c}_te" for c in CATS]), [f"{c}_te" for c in CATS])


_TE_SMOOTH_SQL = with_profile(
    "tr AS (SELECT * FROM order_profile WHERE NOT is_test)",
    "g AS (SELECT sum(label) / count(*) AS g FROM tr)",
    "st AS (" + union_stats(CATS, "tr", "{c} AS value, count(*) AS n, sum(label) AS s", True, "{c}") + ")",
    f"en AS (SELECT feature, value, (s + {ALPHA!r} * g) / (n + {ALPHA!r}) AS enc FROM st, g)",
) + "SELECT p.id, " + ", ".join(
    f"{r6(f'coalesce(e_{c}.enc, g.g)')} AS {c}_te" for c in CATS) + \
    "\nFROM order_profile p CROSS JOIN g\n" + "\n".join(
    f"LEFT JOIN en e_{c} ON e_{c}.feature = '{c}' AND e_{c}.value = p.{c}" for c in CATS)
register("te_smooth", _TE_SMOOTH_SQL)(te_smooth)


# ------------------------------------------------------------------ ENC-4
def _oof_df(spark, sf, alpha=ALPHA):
    tr = CV.stratified_fold(_train(spark, sf), "id", "label", K, SEED)
    return E.oof_encode(tr, CATS, "label", "id", ["fold"], alpha)


def te_oof(spark, sf):
    out = _oof_df(spark, sf)
    cols = [f"{c}_oof" for c in CATS]
    return _r(out.select("id", "fold", *cols), cols)


def _oof_sql(alpha, suffix, extra_select=""):
    ctes, joins, sels = _sql_oof([_strat_sql(SEED)], CATS, alpha,
                                 {(c, 0): f"{c}_{suffix}" for c in CATS})
    return with_profile(
        f"tr AS (SELECT *, {_strat_sql(SEED)} AS f0 FROM order_profile WHERE NOT is_test)",
        *ctes) + "SELECT x.id, x.f0 AS fold, " + ", ".join(
        f"{r6(e)} AS {n}" for n, e in sels) + extra_select + "\nFROM tr x\n" + "\n".join(joins)


register("te_oof", _oof_sql(ALPHA, "oof"))(te_oof)


# ------------------------------------------------------------------ ENC-5
def te_noise(spark, sf):
    out = _oof_df(spark, sf)
    out = E.add_noise(out, [f"{c}_oof" for c in CATS], "id", 0.01, SEED)
    cols = [f"{c}_oof_noise" for c in CATS]
    return _r(out.select("id", *cols), cols)


def _noise_sql():
    ctes, joins, sels = _sql_oof([_strat_sql(SEED)], CATS, ALPHA,
                                 {(c, 0): f"{c}_oof" for c in CATS})
    sel = ", ".join(f"{r6(e + ' + 0.01 * ' + sql_gaussian('x.id', SEED, n))} AS {n}_noise"
                    for n, e in sels)
    return with_profile(
        f"tr AS (SELECT *, {_strat_sql(SEED)} AS f0 FROM order_profile WHERE NOT is_test)",
        *ctes) + f"SELECT x.id, {sel}\nFROM tr x\n" + "\n".join(joins)


register("te_noise", _noise_sql())(te_noise)


# ------------------------------------------------------------------ ENC-6
def te_multi(spark, sf):
    tr = _train(spark, sf)
    out = E.multi_oof(tr, CATS, "label", "id", 3, K, SEED, ALPHA)
    cols = [f"{c}_cv_{i}" for c in CATS for i in (1, 2, 3)]
    return _r(out.select("id", *cols), cols)


def _multi_sql():
    folds = [_strat_sql(SEED + 1), _hash_sql(SEED + 2), _strat_sql(SEED + 3)]
    names = {(c, i): f"{c}_cv_{i + 1}" for c in CATS for i in range(3)}
    ctes, joins, sels = _sql_oof(folds, CATS, ALPHA, names)
    fsel = ", ".join(f"{f} AS f{i}" for i, f in enumerate(folds))
    return with_profile(
        f"tr AS (SELECT *, {fsel} FROM order_profile WHERE NOT is_test)", *ctes
    ) + "SELECT x.id, " + ", ".join(f"{r6(e)} AS {n}" for n, e in sels) + \
        "\nFROM tr x\n" + "\n".join(joins)


register("te_multi", _multi_sql())(te_multi)


# ------------------------------------------------------------------ ENC-7
def te_all(spark, sf):
    tr = _train(spark, sf)
    out = E.encode_all(tr, CATS, "label", "id", K, SEED, ALPHA, 0.01)
    cols = [f"{c}_{s}" for c in CATS for s in ("basic", "noise", "cv_1", "cv_2")]
    return _r(out.select("id", *cols), cols)


def _all_sql():
    folds = [_strat_sql(SEED), _strat_sql(SEED + 1), _hash_sql(SEED + 2)]
    names = {}
    for c in CATS:
        names[(c, 0)], names[(c, 1)], names[(c, 2)] = f"{c}_basic", f"{c}_cv_1", f"{c}_cv_2"
    ctes, joins, sels = _sql_oof(folds, CATS, ALPHA, names)
    fsel = ", ".join(f"{f} AS f{i}" for i, f in enumerate(folds))
    sel = [f"{r6(e)} AS {n}" for n, e in sels]
    for n, e in sels:
        if n.endswith("_basic"):
            c = n[:-6]
            sel.append(f"{r6(e + ' + 0.01 * ' + sql_gaussian('x.id', SEED, n))} AS {c}_noise")
    return with_profile(f"tr AS (SELECT *, {fsel} FROM order_profile WHERE NOT is_test)", *ctes) + \
        "SELECT x.id, " + ", ".join(sel) + "\nFROM tr x\n" + "\n".join(joins)


register("te_all", _all_sql())(te_all)


# ------------------------------------------------------------------ ENC-8
def te_oof_plain(spark, sf):
    df = order_profile(spark, sf)
    tr = CV.stratified_fold(_train(spark, sf), "id", "label", K, SEED)
    names = {(c, 0): f"{c}_enc" for c in CATS}
    tr_enc = E.oof_encode(tr, CATS, "label", "id", ["fold"], 0.0, names)
    model = E.fit_smooth(train_rows(df), CATS, "label", 0.0, suffix="enc")
    te_enc = model.transform(df.filter(F.col("is_test")), "id")
    cols = [f"{c}_enc" for c in CATS]
    out = tr_enc.select("id", "is_test", *cols).unionByName(te_enc.select("id", "is_test", *cols))
    return _r(out, cols)


def _plain_sql():
    ctes, joins, sels = _sql_oof([_strat_sql(SEED)], CATS, 0.0, {(c, 0): f"{c}_enc" for c in CATS})
    train_part = "SELECT x.id, x.is_test, " + ", ".join(f"{r6(e)} AS {n}" for n, e in sels) + \
        "\nFROM tr x\n" + "\n".join(joins)
    test_part = "SELECT p.id, p.is_test, " + ", ".join(
        f"{r6(f'coalesce(m_{c}.enc, g.g)')} AS {c}_enc" for c in CATS) + \
        "\nFROM order_profile p CROSS JOIN g\n" + "\n".join(
        f"LEFT JOIN full_st m_{c} ON m_{c}.feature = '{c}' AND m_{c}.value = p.{c}" for c in CATS) + \
        "\nWHERE p.is_test"
    return with_profile(
        f"tr AS (SELECT *, {_strat_sql(SEED)} AS f0 FROM order_profile WHERE NOT is_test)",
        "g AS (SELECT sum(label) / count(*) AS g FROM tr)",
        "full_st AS (" + union_stats(CATS, "tr", "{c} AS value, sum(label) / count(*) AS enc", True, "{c}") + ")",
        *ctes) + train_part + "\nUNION ALL\n" + test_part


register("te_oof_plain", _plain_sql())(te_oof_plain)


# ------------------------------------------------------------------ ENC-9
def te_test_from_oof(spark, sf):
    df = order_profile(spark, sf)
    tr = E.oof_encode(CV.stratified_fold(_train(spark, sf), "id", "label", K, SEED),
                      CATS, "label", "id", ["fold"], ALPHA)
    test = df.filter(F.col("is_test"))
    out = E.test_from_oof(tr, test, CATS, {c: f"{c}_oof" for c in CATS}, "id")
    cols = [f"{c}_oof" for c in CATS]
    return _r(out.select("id", *cols), cols)


def _test_from_oof_sql():
    ctes, joins, sels = _sql_oof([_strat_sql(SEED)], CATS, ALPHA, {(c, 0): f"{c}_oof" for c in CATS})
    oof = "trenc AS (SELECT x.*, " + ", ".join(f"{e} AS {n}" for n, e in sels) + \
        "\nFROM tr x\n" + "\n".join(joins) + ")"
    means = [f"m_{c} AS (SELECT {c} AS value, avg({c}_oof) AS m FROM trenc WHERE {c} IS NOT NULL GROUP BY {c})"
             for c in CATS]
    gm = "gm AS (SELECT " + ", ".join(f"avg({c}_oof) AS g_{c}" for c in CATS) + " FROM trenc)"
    return with_profile(
        f"tr AS (SELECT *, {_strat_sql(SEED)} AS f0 FROM order_profile WHERE NOT is_test)",
        *ctes, oof, *means, gm) + "SELECT p.id, " + ", ".join(
        f"{r6(f'coalesce(m_{c}.m, gm.g_{c})')} AS {c}_oof" for c in CATS) + \
        "\nFROM order_profile p CROSS JOIN gm\n" + "\n".join(
        f"LEFT JOIN m_{c} ON m_{c}.value = p.{c}" for c in CATS) + "\nWHERE p.is_test"


register("te_test_from_oof", _test_from_oof_sql())(te_test_from_oof)


# ------------------------------------------------------------------ ENC-10
def te_empirical_bayes(spark, sf):
    """Training rows cross-fitted, test rows (fold -1) by the values fitted on all training rows."""
    tr = CV.stratified_fold(_train(spark, sf), "id", "label", K, SEED)
    cols = [f"{c}_eb" for c in CATS]
    train = E.empirical_bayes(tr, CATS, "label", "id", "fold").select("id", "fold", *cols)
    model = E.fit_empirical_bayes(_train(spark, sf), CATS, "label")
    test = model.transform(order_profile(spark, sf).filter("is_test"), "id")
    return _r(train.unionByName(test.select("id", F.lit(-1).cast("int").alias("fold"), *cols)), cols)


def _eb_sql():
    st = union_stats(CATS, "tr", "coalesce({c}, chr(0) || 'null') AS value, fold, count(*) AS n, "
                     "sum(label) AS s, sum(label * label) AS q", False, "coalesce({c}, chr(0) || 'null'), fold")
    body = with_profile(
        f"tr AS (SELECT *, {_strat_sql(SEED)} AS fold FROM order_profile WHERE NOT is_test)",
        "fg AS (SELECT fold, count(*) AS n, sum(label) AS s, sum(label * label) AS q FROM tr GROUP BY fold)",
        """gy AS (SELECT fold, (t.ts - fg.s) / (t.tn - fg.n) AS my,
                 (t.tq - fg.q) / (t.tn - fg.n) - ((t.ts - fg.s) / (t.tn - fg.n)) * ((t.ts - fg.s) / (t.tn - fg.n)) AS vy
          FROM fg, (SELECT sum(n) AS tn, sum(s) AS ts, sum(q) AS tq FROM fg) t)""",
        f"st AS ({st})",
        """sv AS (SELECT feature, value, fold, n,
                 sum(n) OVER w - n AS rn, sum(s) OVER w - s AS rs, sum(q) OVER w - q AS rq
          FROM st WINDOW w AS (PARTITION BY feature, value))""",
        """en AS (SELECT feature, value, sv.fold,
             CASE WHEN rn = 0 OR vy * rn + (rq / rn - (rs / rn) * (rs / rn)) = 0 THEN my
                  ELSE (vy * rn / (vy * rn + (rq / rn - (rs / rn) * (rs / rn)))) * (rs / rn)
                       + (1.0 - vy * rn / (vy * rn + (rq / rn - (rs / rn) * (rs / rn)))) * my END AS enc
          FROM sv JOIN gy USING (fold))""",
        """ga AS (SELECT sum(s) / sum(n) AS my, sum(q) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)) AS vy FROM fg)""",
        """fa AS (SELECT feature, value, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM st GROUP BY feature, value)""",
        """ea AS (SELECT feature, value,
             CASE WHEN vy * n + (q / n - (s / n) * (s / n)) = 0 THEN my
                  ELSE (vy * n / (vy * n + (q / n - (s / n) * (s / n)))) * (s / n)
                       + (1.0 - vy * n / (vy * n + (q / n - (s / n) * (s / n)))) * my END AS enc
          FROM fa, ga)""")
    test = "\nUNION ALL\nSELECT x.id, CAST(-1 AS INTEGER) AS fold, " + ", ".join(
        f"{r6(f'coalesce(e_{c}.enc, ga.my)')} AS {c}_eb" for c in CATS) + \
        "\nFROM order_profile x CROSS JOIN ga\n" + "\n".join(
        f"LEFT JOIN ea e_{c} ON e_{c}.feature = '{c}' AND e_{c}.value = coalesce(x.{c}, chr(0) || 'null')"
        for c in CATS) + "\nWHERE x.is_test"
    return body + "SELECT x.id, x.fold, " + ", ".join(
        f"{r6(f'coalesce(e_{c}.enc, gy.my)')} AS {c}_eb" for c in CATS) + \
        "\nFROM tr x JOIN gy USING (fold)\n" + "\n".join(
        f"LEFT JOIN en e_{c} ON e_{c}.feature = '{c}' AND e_{c}.value = coalesce(x.{c}, chr(0) || 'null') "
        f"AND e_{c}.fold = x.fold" for c in CATS) + test


register("te_empirical_bayes", _eb_sql())(te_empirical_bayes)


# ------------------------------------------------------------- ENC-1 / 2
def label_codes(spark, sf):
    df = order_profile(spark, sf)
    st = E.fit_codes(df, CATS, "nan")
    return E.apply_codes(df, st, CATS, "id", "nan").select("id", *[f"{c}_code" for c in CATS])


_LABEL_CODES_SQL = with_profile(
    "d AS (" + union_stats(CATS, "order_profile", "coalesce({c}, 'nan') AS value", False, "coalesce({c}, 'nan')") + ")",
    "cd AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code FROM d)",
) + "SELECT p.id, " + ", ".join(f"c_{c}.code AS {c}_code" for c in CATS) + \
    "\nFROM order_profile p\n" + "\n".join(
    f"LEFT JOIN cd c_{c} ON c_{c}.feature = '{c}' AND c_{c}.value = coalesce(p.{c}, 'nan')" for c in CATS)
register("label_codes", _LABEL_CODES_SQL)(label_codes)


def ordinal_codes(spark, sf):
    df = order_profile(spark, sf)
    st = E.fit_codes(df, CATS, None)
    out = E.apply_codes(df, st, CATS, "id", None, "ord")
    # codes as doubles (the library encoder's output type; nulls stay null)
    return out.select("id", *[F.col(f"{c}_ord").cast("double").alias(f"{c}_ord") for c in CATS])


_ORD_SQL = with_profile(
    "d AS (" + union_stats(CATS, "order_profile", "{c} AS value", True, "{c}") + ")",
    "cd AS (SELECT feature, value, CAST(dense_rank() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code FROM d)",
) + "SELECT p.id, " + ", ".join(f"CAST(c_{c}.code AS DOUBLE) AS {c}_ord" for c in CATS) + \
    "\nFROM order_profile p\n" + "\n".join(
    f"LEFT JOIN cd c_{c} ON c_{c}.feature = '{c}' AND c_{c}.value = p.{c}" for c in CATS)
register("ordinal_codes", _ORD_SQL)(ordinal_codes)


# ------------------------------------------------------------------ ENC-12
def standardise(spark, sf):
    df = order_profile(spark, sf)
    params = E.fit_standard(train_rows(df), NUMS)
    cols = [f"{c}_std" for c in NUMS]
    return _r(E.apply_standard(df, params).select("id", *cols), cols)


_STD_SQL = with_profile(
    "s AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1.0) AS s_{c}" for c in NUMS) +
    " FROM order_profile WHERE NOT is_test)") + "SELECT id, " + ", ".join(
    f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}_std" for c in NUMS) + " FROM order_profile, s"
register("standardise", _STD_SQL)(standardise)


# --------------------------------------------------------------------- CV
def fold_hash(spark, sf):
    return CV.hash_fold(order_profile(spark, sf), "id", K, SEED).select("id", "fold")


register("fold_hash", with_profile() + f"SELECT id, {_hash_sql(SEED)} AS fold FROM order_profile")(fold_hash)


def fold_strat(spark, sf):
    tr = train_rows(order_profile(spark, sf))
    return CV.stratified_fold(tr, "id", "label", K, SEED).select("id", "label", "fold")


register("fold_strat", with_profile() +
         f"SELECT id, label, {_strat_sql(SEED)} AS fold FROM order_profile WHERE NOT is_test")(fold_strat)


def fold_repeated(spark, sf):
    tr = train_rows(order_profile(spark, sf))
    out = CV.fold_sets(tr, "id", "label", K, (42, 43, 44), ["stratified", "plain", "stratified"])
    return out.select("id", "fold_1", "fold_2", "fold_3")


register("fold_repeated", with_profile() +
         f"SELECT id, {_strat_sql(42)} AS fold_1, {_hash_sql(43)} AS fold_2, {_strat_sql(44)} AS fold_3 "
         "FROM order_profile WHERE NOT is_test")(fold_repeated)


def fold_group(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                               F.col("o_custkey").alias("grp"))
    return CV.group_fold(o, "grp", K, SEED).select("id", "grp", "fold")


register("fold_group",
         f"SELECT o_orderkey AS id, o_custkey AS grp, CAST({sql_hash32('o_custkey', SEED, 'group')} % {K} "
         "AS INTEGER) AS fold FROM orders")(fold_group)


def fold_per_source(spark, sf):
    tr = train_rows(order_profile(spark, sf))
    return CV.per_source_fold(tr, "id", "label", "seg", K, SEED).select("id", "seg", "fold")


register("fold_per_source", with_profile() +
         f"SELECT id, seg, CAST((row_number() OVER (PARTITION BY seg, label ORDER BY {sql_hash32('id', SEED)}, id) - 1)"
         f" % {K} AS INTEGER) AS fold FROM order_profile WHERE NOT is_test")(fold_per_source)
