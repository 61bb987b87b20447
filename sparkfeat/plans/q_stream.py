"""Stream = batch checks as registered queries.

Each ``stream_*`` query fits on the training rows of a batch, keeps the fitted parts in the
shared folder, reads them back, and runs the action-free transform over the written order
profile as a file stream. Its rows must equal those of the batch query's SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfeat.catalog import REGISTRY, register
from sparkfeat.functions.lookup import load_fitted, save_fitted
from sparkfeat.operators import clean as C
from sparkfeat.operators import encode as E
from sparkfeat.operators import models as MD
from sparkfeat.operators import text as T
from sparkfeat.operators.knn import KnnImputer
from sparkfeat.plans import q_clean as QC
from sparkfeat.plans import q_encode as QE
from sparkfeat.plans import q_text as QT
from sparkfeat.plans.sqlkit import r6
from sparkfeat.session import cut_lineage, shared_path
from sparkfeat.sources.fixtures import DOC_FEATURES, doc_profile, order_profile, train_rows
from sparkfeat.sources.tables import read_table
from sparkfeat.streaming.scoring import EventScorer, run_file_stream, score_file_stream


def stream_scoring(spark, sf):
    scorer = EventScorer(alpha=10.0).fit(read_table(spark, sf, "events"))
    out = score_file_stream(spark, scorer, f"{sf}/events.parquet")
    return out.select("event_id", "event_type", F.round("value", 6).alias("value"),
                      F.round("type_mean", 6).alias("type_mean"), F.round("value_z", 6).alias("value_z"),
                      "is_high")


register("stream_scoring", f"""
WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events),
t AS (SELECT event_type AS t, (sum(value) + 10.0 * any_value(m.m)) / (count(*) + 10.0) AS type_mean
      FROM events, m GROUP BY event_type)
SELECT e.event_id, e.event_type, {r6('e.value')} AS value, {r6('coalesce(t.type_mean, m.m)')} AS type_mean,
       {r6('(e.value - m.m) / m.s')} AS value_z, (e.value - m.m) / m.s > 2.0 AS is_high
FROM events e CROSS JOIN m LEFT JOIN t ON e.event_type = t.t""")(stream_scoring)


def _over(df, fit):
    """The table ``df``, written, as a stream through ``fit(written table, folder for its parts)``."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "streamed")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return run_file_stream(spark, path, df.schema, fit(table, shared_path(spark, "fitted")))


def _rounded(cols):
    return {c: F.round(c, 6) for c in cols}


def stream_te_smooth(spark, sf):
    def fit(rows, folder):
        E.fit_smooth(train_rows(rows), QE.CATS, "label", QE.ALPHA).save(folder)
        model = E.SmoothModel.load(folder, spark)
        return lambda s: model.transform(s, "id").select("id", *[f"{c}_te" for c in QE.CATS])
    return _over(order_profile(spark, sf), fit).withColumns(_rounded(f"{c}_te" for c in QE.CATS))


def stream_label_codes(spark, sf):
    def fit(rows, folder):
        save_fitted(folder, spark, codes=E.fit_codes(rows, QE.CATS, "nan"))
        codes = load_fitted(folder, spark)["codes"]
        return lambda s: E.apply_codes(s, codes, QE.CATS, "id", "nan").select("id", *[f"{c}_code" for c in QE.CATS])
    return _over(order_profile(spark, sf), fit)


def stream_standardise(spark, sf):
    def fit(rows, folder):
        save_fitted(folder, spark, params=E.fit_standard(train_rows(rows), QE.NUMS))
        params = load_fitted(folder, spark)["params"]
        return lambda s: E.apply_standard(s, params).select("id", *[f"{c}_std" for c in QE.NUMS])
    return _over(order_profile(spark, sf), fit).withColumns(_rounded(f"{c}_std" for c in QE.NUMS))


def stream_fill_median(spark, sf):
    def fit(rows, folder):
        save_fitted(folder, spark, medians=C.fit_median(train_rows(rows), QC.NUMS))
        medians = load_fitted(folder, spark)["medians"]
        return lambda s: C.apply_fill(s.select("id", *[F.col(c).cast("double").alias(c) for c in QC.NUMS]), medians)
    return _over(order_profile(spark, sf), fit).withColumns(_rounded(QC.NUMS))


def stream_fill_knn(spark, sf):
    def fit(rows, folder):
        KnnImputer(QC.COUNTS, k=5).fit(train_rows(rows)).save(folder)
        fill = KnnImputer.load(folder, spark).for_rows()
        return lambda s: fill(s).select("id", *QC.COUNTS)
    return _over(order_profile(spark, sf), fit).withColumns(_rounded(QC.COUNTS))


def stream_tfidf(spark, sf):
    tokens = {k: T.split_tokens(k, "_") for k in QT.GRAM_GROUPS}

    def fit(rows, folder):
        save_fitted(folder, spark, vocab=T.fit_tfidf(rows.filter("not is_test"), tokens, 2, 100))
        vocab = load_fitted(folder, spark)["vocab"]
        return lambda s: T.row_tfidf(s, "id", tokens, vocab)
    docs = QT.gram_docs(spark, sf)
    return _over(docs, fit).withColumn("tfidf", F.round("tfidf", 6))


for _name, _fn in (("te_smooth", stream_te_smooth), ("label_codes", stream_label_codes),
                   ("standardise", stream_standardise), ("fill_median", stream_fill_median),
                   ("fill_knn", stream_fill_knn), ("tfidf_combo", stream_tfidf)):
    register(_fn.__name__, REGISTRY[_name][1])(_fn)


def stream_clusters(spark, sf):
    """k-means and principal components of the document profile: how often each document came out
    of the stream, and whether its cluster and components equal those of the batch."""
    feats = list(DOC_FEATURES)
    wanted = ["doc_id", "cluster", "pca_0", "pca_1", "pca_2"]
    batch = []

    def fit(rows, folder):
        train = cut_lineage(rows.filter(~F.col("is_test")))
        MD.fit_kmeans(train, feats, 5, 42).save(f"{folder}/kmeans", spark)
        MD.fit_pca(train, feats, 3).save(f"{folder}/pca", spark)
        km, pca = MD.KMeansColumns.load(f"{folder}/kmeans", spark), MD.PcaColumns.load(f"{folder}/pca", spark)
        apply = lambda s: pca.transform(km.transform(s.select("doc_id", *feats))).select(*wanted)
        batch.append(apply(rows))
        return apply

    streamed = _over(doc_profile(spark, sf), fit)
    both = streamed.withColumn("n_stream", F.lit(1)).unionByName(batch[0].withColumn("n_stream", F.lit(0)))
    return both.groupBy("doc_id").agg(F.sum("n_stream").alias("n_stream"),
                                      (F.count_distinct(F.struct(*wanted)) == 1).alias("same"))


register("stream_clusters", "SELECT doc_id, count(*) AS n_stream, true AS same FROM documents GROUP BY doc_id")(stream_clusters)
