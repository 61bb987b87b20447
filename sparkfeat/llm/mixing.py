"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree (domain, language, source). Each node shares
its budget among its children by weight; a child cannot take more than its subtree
holds (tokens times ``max_epochs``), and what it cannot take goes to its siblings
by weight. Only when all siblings are full does the shortage reach the ancestor:
a node's capacity is the sum of its children's. Each leaf then reads its documents
in seeded epochs, every epoch in an order of its own, and the selection is the
prefix of that stream with exactly the leaf's tokens; the last document is cut.

Only DataFrame operations. The cut in the last, partial epoch is found by radix:
sums over 1,024 slices of the order hash per leaf, then inside the slice that holds
the cut, so no task ever sorts a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, table

LEVELS = ["domain", "lang", "source"]
WEIGHTS = {
    "domain": {"web": 5, "books": 3, "code": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src1": 3, "src2": 2, "src3": 2},
}
RADIX = 10               # bits of the order hash looked at in one round
HASH_BITS = 60
EXACT_ROWS = 4096        # a slice of at most so many documents is summed row by row
BROADCAST_LEAVES = 50_000
NAMES = ["n_tokens", "epoch", "take_tokens", *LEVELS]


def count_tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column, tk: Column) -> Column:
    """60-bit order of a document in a seeded epoch; rows without an id are spread by their text key."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                      F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), tk.cast("string"))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _weight(level: str, weights: dict) -> Column:
    own = weights.get(level, {})
    if any(int(v) != v or v < 0 for v in own.values()):
        raise ValueError("weights are whole numbers, 0 or more")
    if not own:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[x for k, v in sorted(own.items()) for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    return F.coalesce(F.get(F.array(pairs[F.col(level)]), 0), F.lit(1).cast("long"))


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Allocate ``budget`` of each parent among its children (columns cap, weight).

    Children sorted by cap/weight fill up first; the rest share what is left by
    weight, whole tokens, the remainder going one each to the first names.
    """
    d = lambda c: F.col(c).cast("decimal(19,0)")
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.try_divide("cap", "weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    out = (nodes.withColumn("budget", F.least("budget", F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)).over(by)))
           .withColumn("_c", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(before), F.lit(0)))
           .withColumn("_w", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
           .withColumn("_full", (F.col("weight") > 0) & (d("cap") * d("_w") <= d("weight") * (d("budget") - d("_c")).cast("decimal(19,0)")))
           .withColumn("_left", F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(by))
           .withColumn("_sum", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(by))
           .withColumn("_num", d("_left") * d("weight")).withColumn("_den", F.greatest(d("_sum"), F.lit(1)))
           .withColumn("_part", F.when(F.col("_full") | (F.col("weight") == 0), 0).otherwise(F.expr("_num div _den")))
           .withColumn("_rest", F.col("_left") - F.sum("_part").over(by))
           .withColumn("_turn", F.row_number().over(by.orderBy(F.col("_full") | (F.col("weight") == 0), name)))
           .withColumn("alloc", F.when(F.col("_full"), F.col("cap")).when(F.col("weight") == 0, 0)
                       .otherwise(F.col("_part") + (F.col("_turn") <= F.col("_rest")).cast("int")).cast("long")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def allocate(leaves: DataFrame, weights: dict, budget: Column, max_epochs: int) -> DataFrame:
    """Leaf table (levels, tokens) with the tokens allocated to each leaf: ``alloc``."""
    level = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    for k, name in enumerate(LEVELS):               # a child of weight 0 takes nothing, nor does its subtree
        level = level.withColumn(f"w_{name}", _weight(name, weights))
    usable = F.lit(True)
    for name in LEVELS:
        usable = usable & (F.col(f"w_{name}") > 0)
    level = level.withColumn("cap", F.when(usable, F.col("cap")).otherwise(0).cast("long"))
    top = level.groupBy("domain").agg(F.sum("cap").alias("cap"), F.max("w_domain").alias("weight"))
    got = share_out(top.withColumn("budget", budget.cast("long")), [], "domain").select("domain", F.col("alloc").alias("budget"))
    mid = level.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.max("w_lang").alias("weight"))
    got = share_out(mid.join(got, "domain"), ["domain"], "lang").select("domain", "lang", F.col("alloc").alias("budget"))
    low = level.withColumn("weight", F.col("w_source")).join(got, ["domain", "lang"])
    return share_out(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "alloc")


def mixing_plan(meta: DataFrame, weights: dict, budget_share: float | None, budget: int | None,
                max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: whole epochs, and the cut in the partial one (hash, id, text key, copies, their tokens)."""
    leaves = materialize(meta.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    want = int(budget if budget is not None else total * budget_share)
    plan = allocate(leaves.where("tokens > 0"), weights, F.lit(want), max_epochs)
    plan = plan.select(*LEVELS, (F.expr("alloc div tokens")).cast("long").alias("whole"),
                       F.expr("alloc % tokens").cast("long").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    state, shift = materialize(plan, "plan"), HASH_BITS
    drop_materialized(leaves)
    while True:
        small = F.broadcast if state.count() <= BROADCAST_LEAVES else (lambda x: x)
        inside = (meta.where("n_tokens > 0").join(small(state.where("rest > 0")), LEVELS)
                  .withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id"), F.col("tk")))
                  .where(F.shiftright("h", shift) == F.col("prefix")))
        # rows per leaf whose cut is still among too many documents
        most = inside.groupBy(*LEVELS).count().agg(F.max("count")).first()[0] or 0
        if most <= EXACT_ROWS or shift == 0:
            break
        shift -= RADIX
        by = W.partitionBy(*LEVELS).orderBy("slice")
        slices = (inside.groupBy(*LEVELS, F.shiftright("h", shift).alias("slice"))
                  .agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"))
                  .withColumn("before", F.sum("t").over(by) - F.col("t"))
                  .where("before < rest and rest <= before + t")
                  .select(*LEVELS, "slice", (F.col("rest") - F.col("before")).alias("left")))
        new = (state.join(slices, LEVELS, "left")
               .select(*LEVELS, "whole", F.coalesce("left", F.lit(0)).alias("rest"), F.coalesce("slice", F.lit(0)).alias("prefix")))
        old, state = state, materialize(new, "plan")
        drop_materialized(old)
    by = W.partitionBy(*LEVELS).orderBy("h", "doc_id", "tk")
    same = (inside.groupBy(*LEVELS, "h", "doc_id", "tk").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("copies"), F.first("rest").alias("rest"))
            .withColumn("before", F.sum("t").over(by) - F.col("t")).where("before < rest and rest <= before + t")
            .select(*LEVELS, F.col("h").alias("cut_h"), F.col("doc_id").alias("cut_id"), F.col("tk").alias("cut_tk"),
                    "copies", (F.col("rest") - F.col("before")).alias("cut_take")))
    done = state.select(*LEVELS, "whole", (F.col("rest") > 0).alias("partial")).join(same, LEVELS, "left")
    return materialize(done, "mixing")


def select_mixture(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows (levels, doc_id, tk, n_tokens, ...) in every epoch that takes tokens of them.

    Equal rows at a leaf's cut are interchangeable: one of them stands for all, and is
    repeated as often as whole copies fit, then once more with the tokens that are left.
    """
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else (lambda x: x)
    h = order_hash(seed, F.col("whole"), F.col("doc_id"), F.col("tk"))
    low = F.struct(F.col("__h"), F.col("doc_id"), F.col("tk"))
    cut = F.struct(F.col("cut_h"), F.col("cut_id"), F.col("cut_tk"))
    last = F.when(~F.col("partial"), 0).when(low < cut, F.col("n_tokens")).when((low == cut) & (F.col("copies") == 1), F.col("cut_take")).otherwise(0)
    out = rows.where("n_tokens > 0").join(small(plan), LEVELS).withColumn("__h", h).withColumn("__last", last.cast("long"))
    epochs = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda e: F.struct(
        e.alias("epoch"), F.when(e < F.col("whole"), F.col("n_tokens")).otherwise(F.col("__last")).alias("take_tokens"))),
        lambda x: x["take_tokens"] > 0)
    taken = out.select(*rows.columns, F.explode(epochs).alias("__e")).select(
        *rows.columns, F.col("__e.epoch").alias("epoch"), F.col("__e.take_tokens").alias("take_tokens"))
    groups = plan.where("copies > 1")
    if groups.isEmpty():
        return taken
    key = [*LEVELS, "doc_id", "tk"]
    one = (rows.where("n_tokens > 0").join(small(groups), LEVELS)
           .where(F.col("tk") == F.col("cut_tk")).where(F.col("doc_id").eqNullSafe(F.col("cut_id")))
           .groupBy(*key).agg(*[F.first(c).alias(c) for c in [*rows.columns, "whole", "cut_take"] if c not in key]))
    n = F.col("n_tokens")
    takes = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(cut_take - 1) div n_tokens")),
                        lambda i: F.least(n, F.col("cut_take") - i * n))
    return taken.unionByName(one.select(*rows.columns, F.col("whole").alias("epoch"), F.explode(takes).alias("take_tokens")))


def tagged(docs: DataFrame, domain: Column, lang: str, source: str, doc_id: str, text: str, keep_text: bool) -> DataFrame:
    none = F.lit("(none)")
    cols = [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(domain.cast("string"), none).alias("domain"),
            F.coalesce(F.col(lang).cast("string"), none).alias("lang"), F.coalesce(F.col(source).cast("string"), none).alias("source"),
            count_tokens(F.col(text)).alias("n_tokens"), F.xxhash64(text).alias("tk")]
    return docs.select(*cols, *([F.col(text).alias("text")] if keep_text else []))


def mix_sources(docs: DataFrame, domain: Column, lang: str = "lang", source: str = "source",
                doc_id: str = "doc_id", text: str = "text", weights: dict = WEIGHTS,
                budget_share: float | None = 0.5, budget: int | None = None, max_epochs: int = 4,
                seed: int = 2024, with_text: bool = True) -> DataFrame:
    """Select token prefixes of seeded epochs so that the leaves meet their weights.

    ``budget`` tokens, or ``budget_share`` of all tokens. Returns doc_id, domain, lang,
    source, n_tokens, (text,) epoch, take_tokens: one row per document and epoch that
    takes tokens of it; take_tokens < n_tokens only for a leaf's last document, whose
    text is then its first words joined by one space.
    Names without a weight have weight 1; weight 0 takes nothing. Null domain, lang or
    source form the leaf "(none)"; null or blank texts have no tokens and are never
    taken; rows without a doc_id are ordered by their text's hash; repeated rows (same id
    and text) stand side by side in an epoch, so at a cut whole copies are taken first and
    one is cut. An empty
    table, or a budget of 0, gives no rows; a budget over all capacity takes all of it.
    Other columns are ignored.
    """
    meta = materialize(tagged(docs, domain, lang, source, doc_id, text, False), "tokens")
    plan = mixing_plan(meta, weights, budget_share, budget, max_epochs, seed)
    rows = tagged(docs, domain, lang, source, doc_id, text, True) if with_text else meta
    out = select_mixture(rows, plan, seed).drop("tk")
    if with_text:
        cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1,
                                   F.col("take_tokens").cast("int")), " ")
        out = out.withColumn("text", F.when(F.col("take_tokens") < F.col("n_tokens"), cut).otherwise(F.col("text")))
    return out


def domain_of(source: Column) -> Column:
    """The example domains of the test tables: src0 is the crawl, odd numbers books, even ones code."""
    number = F.regexp_extract(source, r"^src([0-9]+)$", 1)
    return (F.when(source == "src0", "web").when(number == "", "other")
            .when(F.substring(number, -1, 1).isin("1", "3", "5", "7", "9"), "books").otherwise("code"))


def op5_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, domain_of(F.col("source")), with_text=False)


def _values(level):
    return ", ".join(f"('{k}', {v})" for k, v in WEIGHTS[level].items())


def _share_sql(source: str, parent: str, name: str) -> str:
    """The rows of ``source`` (parent columns, name, cap, weight, budget) with alloc."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
  SELECT *, CASE WHEN isfull THEN cap ELSE part + CASE WHEN turn <= rest THEN 1 ELSE 0 END END AS alloc FROM (
    SELECT *, leftover - sum(part) OVER ({by}) AS rest, row_number() OVER ({by} ORDER BY isfull, {name}) AS turn FROM (
      SELECT *, CASE WHEN isfull THEN 0 ELSE leftover::HUGEINT * weight // greatest(sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ({by}), 1) END AS part FROM (
        SELECT *, b - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({by}) AS leftover FROM (
          SELECT *, cap::HUGEINT * wfrom <= weight::HUGEINT * (b - cbefore) AS isfull FROM (
            SELECT *, least(budget, sum(cap) OVER ({by})) AS b,
              coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cbefore,
              sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wfrom
            FROM {source})))))"""


def mixing_sql(documents: str = "documents", share: float = 0.5, max_epochs: int = 4, seed: int = 2024,
               columns: str = "") -> str:
    """DuckDB SQL for ``mix_sources`` with the default weights over ``documents`` (doc_id unique, no nulls)."""
    return rf"""
WITH wd(k, w) AS (VALUES {_values('domain')}), wl(k, w) AS (VALUES {_values('lang')}), ws(k, w) AS (VALUES {_values('source')}),
meta AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens{columns},
    CASE WHEN source = 'src0' THEN 'web' WHEN NOT regexp_matches(source, '^src[0-9]+$') THEN 'other'
         WHEN CAST(substr(source, 4) AS BIGINT) % 2 = 1 THEN 'books' ELSE 'code' END AS domain
  FROM {documents}
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS cap
  FROM meta GROUP BY ALL HAVING sum(n_tokens) > 0
), top AS (
  SELECT domain, sum(cap)::BIGINT AS cap, max(coalesce(w, 1)) AS weight,
         (SELECT CAST(floor(sum(n_tokens) * {share}) AS BIGINT) FROM meta) AS budget
  FROM leaves LEFT JOIN wd ON k = domain GROUP BY domain
), top2 AS ({_share_sql('top', '', 'domain')}
), mid AS (
  SELECT l.domain, lang, sum(l.cap)::BIGINT AS cap, max(coalesce(w, 1)) AS weight, max(t.alloc)::BIGINT AS budget
  FROM leaves l LEFT JOIN wl ON k = lang JOIN top2 t ON t.domain = l.domain GROUP BY l.domain, lang
), mid2 AS ({_share_sql('mid', 'domain', 'lang')}
), low AS (
  SELECT l.domain, l.lang, l.source, l.cap, l.tokens, coalesce(w, 1) AS weight, m.alloc::BIGINT AS budget
  FROM leaves l LEFT JOIN ws ON k = source JOIN mid2 m ON m.domain = l.domain AND m.lang = l.lang
), low2 AS ({_share_sql('low', 'domain, lang', 'source')}
), plan AS (
  SELECT domain, lang, source, (alloc // tokens)::BIGINT AS whole, (alloc % tokens)::BIGINT AS rest FROM low2
), ordered AS (
  SELECT m.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY m.domain, m.lang, m.source
      ORDER BY ('0x' || substr(md5('{seed}:' || whole || ':' || doc_id), 1, 15))::BIGINT, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM meta m JOIN plan p ON m.domain = p.domain AND m.lang = p.lang AND m.source = p.source
), epochs AS (
  SELECT *, unnest(range(0, whole + 1)) AS epoch FROM ordered
), taken AS (
  SELECT *, CASE WHEN epoch < whole THEN n_tokens ELSE greatest(0, least(n_tokens, rest - start)) END AS take_tokens FROM epochs
)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, epoch::BIGINT AS epoch, take_tokens::BIGINT AS take_tokens{columns}
FROM taken WHERE take_tokens > 0
"""


OP5_SQL = mixing_sql()
