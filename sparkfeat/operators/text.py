"""Column combinations, tokens and TF-IDF (TXT-1..10).

TF-IDF is a chain of distributed aggregates: document frequency and total
per token straight from the rows (map-side combined, so a token present in a
third of all documents is no hot spot), a vocabulary (bounded by
``max_features``, or all eligible terms), and weights row by row where the
vocabulary is proven small, else by blocks of rows, of which only the distinct
terms are joined to the vocabulary.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfeat.functions.lookup import State, fit_state, lookup_join
from sparkfeat.session import written


# ------------------------------------------------------------- TXT-1..5
def combos(cols, r: int, sep: str = "-", forbid=()) -> dict:
    """All r-combinations of the declared columns as ``concat_ws`` expressions.

    Columns in ``forbid`` (the label, ids) are refused (T19)."""
    bad = [c for c in cols if c in set(forbid)]
    if bad:
        raise ValueError(f"refusing to combine {bad}")
    return {sep.join(c) if sep == "_" else "-".join(c): F.concat_ws(sep, *[F.col(x) for x in c])
            for c in itertools.combinations(cols, r)}


def combo_names(cols, r: int) -> list[str]:
    return ["-".join(c) for c in itertools.combinations(cols, r)]


def chosen_combos(df: DataFrame, groups, sep: str = "_", suffix: str = "") -> dict:
    """TXT-4/5: listed column tuples; a tuple with an absent column is skipped."""
    out = {}
    for g in groups:
        if all(c in df.columns for c in g):
            name = sep.join(g) + suffix
            meta = {FAMILY: f"{len(g)}-gram"} if len(g) in (4, 5) else {}
            out[name] = F.concat_ws(sep, *[F.col(c) for c in g]).alias(name, metadata=meta)
    return out


def unseparated_triple(a: str, b: str, c: str) -> Column:
    """TXT-3: the variant ``a-bc`` (second separator missing)."""
    return F.concat(F.col(a), F.lit("-"), F.col(b), F.col(c))


# ------------------------------------------------------------------ TXT-6
def split_tokens(c, sep: str = "_") -> Column:
    """Tokens between separators, empty tokens dropped, case kept."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(col, sep), lambda t: t != "")


def word_tokens(c) -> Column:
    """Runs of two or more letters or digits of any script, lower-cased (document text)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(F.regexp_extract_all(col, F.lit(r"[\p{L}\p{N}]{2,}"), 0), lambda t: F.lower(t))


# ------------------------------------------------------------------ TXT-7
def fit_tfidf(train: DataFrame, tokens: dict, min_df: int = 2, max_features: int | None = 100) -> State:
    """Vocabulary (feature, token, df, idf, and with ``max_features`` alpha_rank, df_rank).

    ``tokens`` maps a feature name to an array<string> Column. Per feature: terms with
    document frequency ≥ min_df; of them the ``max_features`` most frequent by total
    count (ties by token), or all with ``max_features=None``.
    """
    feats = list(tokens)
    prepared = F.array_distinct if max_features is None else F.array_sort     # totals only choose the most frequent
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), prepared(tokens[f]).alias("toks")) for f in feats])
    rows = train.select(F.explode(arr).alias("ft")).select("ft.feature", "ft.toks")
    # tokens of a row are sorted (or distinct): the first of equal ones counts the document
    again = (F.col("i") > 0) & (F.col("token") == F.get("toks", F.col("i") - 1))
    stats = (rows.select("feature", "toks", F.posexplode("toks").alias("i", "token"))
             .select("feature", "token", F.when(again, 0).otherwise(1).alias("first"))
             .groupBy("feature", "token").agg(F.sum("first").alias("df"), F.count("*").alias("total")))
    n_docs = train.count()
    eligible = written(stats.filter(F.col("df") >= min_df), "terms")      # read once per feature, counted once
    idf = _idf(n_docs)
    if max_features is None:
        return fit_state(eligible.select("feature", "token", "df", idf.alias("idf")))
    # top-k per feature as ordered limits (partial top-k per task, then merge):
    # never a window that gathers all tokens of a feature in one task
    top = None
    for f in feats:
        part = (eligible.filter(F.col("feature") == f)
                .orderBy(F.desc("total"), F.asc("token")).limit(max_features))
        top = part if top is None else top.unionByName(part)
    bound = max_features * len(feats)
    vocab = fit_state(top, max_rows=bound).df.select(
        "feature", "token", "df", idf.alias("idf"),
        F.row_number().over(Window.partitionBy("feature").orderBy("token")).alias("alpha_rank"),
        F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("df"), "token")).alias("df_rank"))
    return fit_state(vocab, max_rows=bound)


def _idf(n_docs: int) -> Column:
    return F.log(F.lit(float(n_docs + 1)) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)


def _one_row_per_id(df: DataFrame, id_col: str, tokens: dict) -> tuple[DataFrame, dict]:
    """Rows with the tokens of all rows of an id together, and the columns that hold them. Where
    no id repeats (counted by a shuffle of the ids alone) the rows stay where they are."""
    if df.groupBy(id_col).agg(F.count("*").alias("__n")).filter("__n > 1").isEmpty():
        return df, tokens
    cols = {f: f"__tokens{i}" for i, f in enumerate(tokens)}
    whole = df.groupBy(id_col).agg(*[F.flatten(F.collect_list(tokens[f])).alias(c) for f, c in cols.items()])
    return whole, {f: F.col(c) for f, c in cols.items()}


def transform_tfidf(df: DataFrame, id_col: str, tokens: dict, vocab_st: State) -> DataFrame:
    """Weights (id, feature, token, tfidf) of any rows by a fitted vocabulary, L2 norm 1 per id and feature.

    A vocabulary proven small is sent to the tasks, which weigh each row where it is: no token is
    shuffled or sorted. A larger one is joined to the distinct terms of blocks of rows.
    """
    rows, toks = _one_row_per_id(df, id_col, tokens)
    if vocab_st.small and vocab_st.rows is not None:
        return row_tfidf(rows, id_col, toks, vocab_st)
    return _block_tfidf(_blocks(rows, id_col, toks), id_col, vocab_st)


BLOCK = 2_000_000       # tokens of the rows that are counted and weighed together


def _blocks(df: DataFrame, id_col: str, tokens: dict) -> DataFrame:
    """The counted terms of all rows as files, one row per feature and block of rows read one after the other.

    ``terms``: the distinct terms of the block, ``df``: how many of its rows have each; ``ids``: its
    rows, ``n``: how many terms each has; then row by row ``term``, the place in ``terms``, and
    ``tf``, how often the row has it. The tokens are split once, here; every later step reads these files.
    """
    cols = {f: f"__tokens{i}" for i, f in enumerate(tokens)}
    rows = df.select(F.col(id_col).alias("__id"), *[tokens[f].alias(c) for f, c in cols.items()])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)      # noqa: E731
    ints = lambda values: one(pa.array(values, pa.int32()))      # noqa: E731

    def counted(feature, ids, words, sizes):
        coded = pc.dictionary_encode(pc.cast(pc.list_flatten(words), pa.string()), null_encoding="encode")
        k = max(len(coded.dictionary), 1)
        pair, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * k + coded.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(pair, k)
        return pa.RecordBatch.from_arrays(
            [pa.array([feature]), one(coded.dictionary), ints(np.bincount(term, minlength=len(coded.dictionary))), one(ids),
             ints(np.bincount(row, minlength=len(sizes))), ints(term), ints(tf)], ["feature", "terms", "df", "ids", "n", "term", "tf"])

    def count(batches):
        for batch in batches:
            for f, c in cols.items():
                sizes = pc.fill_null(pc.list_value_length(batch[c]), 0).to_numpy().astype(np.int64)
                _, starts = np.unique(np.cumsum(sizes) // BLOCK, return_index=True)
                for at, end in zip(starts, [*starts[1:], len(sizes)]):
                    yield counted(f, batch["__id"].slice(at, end - at), batch[c].slice(at, end - at), sizes[at:end])

    kind = rows.schema["__id"].dataType.simpleString()
    made = rows.mapInArrow(count, "feature string, terms array<string>, df array<int>, ids array<" + kind + ">, n array<int>, "
                                  "term array<int>, tf array<int>")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "counted")


def _block_tfidf(blocks: DataFrame, id_col: str, vocab_st: State) -> DataFrame:
    """Weights of the rows of ``_blocks``: the terms of each block, each once, are joined to the vocabulary,
    then its rows are weighed and brought to norm 1 by what was found. The terms of a row are
    never shuffled one by one, and a term that most rows have is joined once a block."""
    terms = blocks.select(F.col("block").alias("of"), "feature", F.posexplode("terms").alias("place", "token"))
    vocab_st = State(vocab_st.df.select("feature", "token", "idf"), vocab_st.small)
    known = lookup_join(terms, vocab_st, ["feature", "token"], how="inner", allow_map=False)     # hash lookups for the many terms

    def weigh(block: pa.Table, found: pa.Table) -> pa.Table:
        part = {c: pc.list_flatten(block[c].combine_chunks()) for c in ("terms", "ids", "n", "term", "tf")}
        idf, fits = np.zeros(len(part["terms"])), np.zeros(len(part["terms"]), bool)
        idf[found["place"].to_numpy()], fits[found["place"].to_numpy()] = found["idf"].to_numpy(), True
        row, term = np.repeat(np.arange(len(part["ids"])), part["n"].to_numpy()), part["term"].to_numpy()
        keep = fits[term]
        row, term = row[keep], term[keep]
        w = part["tf"].to_numpy()[keep] * idf[term]
        norm = np.sqrt(np.bincount(row, w * w, len(part["ids"])))
        return pa.table({"id": part["ids"].take(pa.array(row)), "feature": pa.repeat(block["feature"][0], len(row)),
                         "token": part["terms"].take(pa.array(term)), "tfidf": pa.array(w / norm[row])})

    made = blocks.select(F.get("ids", F.lit(0)).alias("id"), "feature", F.get("terms", F.lit(0)).alias("token"), F.lit(0.0).alias("tfidf")).schema
    # a partition takes some blocks: more rows, more partitions
    n = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.count() // 4)
    given = blocks.select("block", "feature", "terms", "ids", "n", "term", "tf").repartition(n, "block").groupBy("block")
    known = known.select("of", "place", "idf").repartition(n, "of").groupBy("of")
    return given.cogroup(known).applyInArrow(weigh, made).withColumnRenamed("id", id_col)


def row_tfidf(df: DataFrame, id_col: str, tokens: dict, vocab_st: State) -> DataFrame:
    """As ``transform_tfidf``, but row by row: no shuffle and no action, so it runs on a stream.

    The vocabulary must be proven small (it is sent to every task). Rows that share an id are
    weighted each on its own, where ``transform_tfidf`` counts them together.
    """
    idf: dict = {f: {} for f in tokens}
    for r in vocab_st.collect():
        if r.feature in idf and r.token is not None:       # as in the join, a null token matches nothing
            idf[r.feature][r.token] = r.idf
    sent = df.sparkSession.sparkContext.broadcast(idf)

    def weigh(feature: str):
        @F.arrow_udf("array<struct<token: string, tfidf: double>>")
        def weights(words: pa.Array) -> pa.Array:
            known = sent.value[feature]
            vocabulary = pa.array(list(known), pa.string())
            row = pc.list_parent_indices(words).to_numpy().astype(np.int64)
            place = pc.index_in(pc.cast(pc.list_flatten(words), pa.string()), vocabulary)
            found = place.is_valid().to_numpy(zero_copy_only=False)
            pair, tf = np.unique(row[found] * max(len(vocabulary), 1) + place.drop_null().to_numpy(), return_counts=True)
            row, term = np.divmod(pair, max(len(vocabulary), 1))
            w = tf * np.array(list(known.values()), float)[term] if len(pair) else np.zeros(0)
            norm = np.sqrt(np.bincount(row, w * w, len(words)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])
            pairs = pa.StructArray.from_arrays([vocabulary.take(pa.array(term)), pa.array(w / norm[row])], names=["token", "tfidf"])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        return weights

    arr = F.array(*[F.struct(F.lit(f).alias("feature"), weigh(f)(t).alias("terms")) for f, t in tokens.items()])
    return (df.select(id_col, F.explode(arr).alias("ft")).select(id_col, "ft.feature", F.explode("ft.terms").alias("t"))
            .select(id_col, "feature", "t.token", "t.tfidf"))


def tfidf(df: DataFrame, id_col: str, tokens: dict, min_df: int = 2, max_features: int | None = 100,
          fit_on: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Smooth-idf TF-IDF with L2 row norm for several token columns at once: (weights of
    ``df``, vocabulary). Vocabulary and idf come from ``fit_on`` (the training rows;
    default: all rows). With ``max_features=None`` rows that are fitted and weighed are split
    into tokens once, and no part of the vocabulary is collected."""
    if fit_on is None and max_features is None:
        whole, toks = _one_row_per_id(df, id_col, tokens)
        blocks = _blocks(df, id_col, tokens)
        stats = blocks.select("feature", F.inline(F.arrays_zip(F.col("terms").alias("token"), F.col("df").alias("df"))))
        stats = stats.groupBy("feature", "token").agg(F.sum("df").alias("df")).filter(F.col("df") >= min_df)
        vocab = written(stats.select("feature", "token", "df", _idf(df.count()).alias("idf")), "terms")
        if whole is not df:         # fitted row by row, weighed by id
            blocks = _blocks(whole, id_col, toks)
        return _block_tfidf(blocks, id_col, State(vocab, False)), vocab
    vocab = fit_tfidf(df if fit_on is None else fit_on, tokens, min_df, max_features)
    return transform_tfidf(df, id_col, tokens, vocab), vocab.df


def dense_top_terms(df: DataFrame, weights: DataFrame, vocab: DataFrame, id_col: str,
                    k: int = 5, order: str = "token") -> DataFrame:
    """TXT-8: k vocabulary terms as dense columns — the first k in token order
    (the reference's choice, T10) or, with ``order="df"``, the k most common.

    Columns ``<feature>_t1 .. _tk`` (0.0 where the row lacks the term); the
    term behind each slot is in ``vocab.alpha_rank`` / ``vocab.df_rank``.
    """
    rank = {"token": "alpha_rank", "df": "df_rank"}[order]
    feats = [r.feature for r in vocab.select("feature").distinct().collect()]  # ≤ #features rows
    first = weights.join(F.broadcast(vocab.filter(F.col(rank) <= k)
                                     .select("feature", "token", F.col(rank).alias("__slot"))),
                         ["feature", "token"])
    keyed = first.select(id_col, F.concat_ws("_t", "feature", F.col("__slot").cast("string")).alias("slot"),
                         "tfidf")
    slots = [f"{f}_t{i}" for f in sorted(feats) for i in range(1, k + 1)]
    wide = keyed.groupBy(id_col).agg(*[F.max(F.when(F.col("slot") == s, F.col("tfidf"))).alias(s) for s in slots])
    out = df.select(id_col).join(wide, id_col, "left")
    return tag_family(out.fillna(0.0, subset=slots), "TF-IDF", slots)


# ------------------------------------------------------------------ TXT-9
def low_info_report(df: DataFrame, string_cols, numeric_cols, min_unique_ratio: float = 0.01,
                    min_var: float = 1e-6) -> DataFrame:
    """(feature, kind, stat, kept): distinct ratio for strings, variance for numbers.

    Distinct counts come from one unpivot + distinct + count (a distributed
    shuffle), not from per-column count-distinct jobs.
    """
    parts = []
    if string_cols:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in string_cols]).unpivot(
            [], list(string_cols), "feature", "value")
        nd = long.filter(F.col("value").isNotNull()).distinct().groupBy("feature").agg(
            F.count("*").alias("n_distinct"))
        names = df.sparkSession.createDataFrame([(c,) for c in string_cols], "feature string")   # all-null columns stay
        total = max(df.count(), 1)
        parts.append(names.join(nd, "feature", "left").fillna(0, subset=["n_distinct"])
                     .select("feature", F.lit("string").alias("kind"), (F.col("n_distinct") / F.lit(float(total))).alias("stat"))
                     .withColumn("kept", F.col("stat") > min_unique_ratio))
    if numeric_cols:
        row = df.agg(*[F.var_samp(c).alias(c) for c in numeric_cols])
        long = row.unpivot([], list(numeric_cols), "feature", "stat").select(
            "feature", F.lit("numeric").alias("kind"), "stat")
        parts.append(long.withColumn("kept", F.coalesce(F.col("stat") > min_var, F.lit(False))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------- TXT-10
# Part of a column's name (any case) and the family it stands for.
FAMILY_RULES = (("tfidf", "TF-IDF"), ("4gram", "4-gram"), ("5gram", "5-gram"))
FAMILY = "family"       # key in the column's metadata


def family_of(name_col, originals=()) -> Column:
    """Family by name, upper and lower case alike: TF-IDF, 4-gram, 5-gram, Original (the name
    holds that of a column in ``originals``), else Other. The first rule that fits counts."""
    col = F.lower(F.col(name_col) if isinstance(name_col, str) else name_col)
    expr = F
    for needle, family in (*FAMILY_RULES, *((c.lower(), "Original") for c in originals)):
        expr = expr.when(col.contains(needle), F.lit(family))
    return expr.otherwise(F.lit("Other"))


def tag_family(df: DataFrame, family: str, cols) -> DataFrame:
    """Note in the columns' metadata what they are; selects and renames carry it along."""
    for c in cols:
        df = df.withMetadata(c, {**df.schema[c].metadata, FAMILY: family})
    return df


def feature_families(df: DataFrame, cols=None, originals=()) -> DataFrame:
    """(feature, family, tagged) of the columns: the family set by the operator that made the
    column, else by the rules of ``family_of``. One row per column."""
    rows = [(c, df.schema[c].metadata.get(FAMILY)) for c in (df.columns if cols is None else cols)]
    names = df.sparkSession.createDataFrame(rows, "feature string, tag string")
    return names.select("feature", F.coalesce("tag", family_of("feature", originals)).alias("family"),
                        F.col("tag").isNotNull().alias("tagged"))
