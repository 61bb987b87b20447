"""Layer 5: a fitted transform gives the same rows on a stream as on a batch."""

import pytest
from pyspark.sql import functions as F

from sparkfeat.sources.tables import read_table
from sparkfeat.streaming.scoring import EventScorer, score_file_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    events = read_table(spark, SF_SMALL, "events")
    scorer = EventScorer().fit(events)
    batch = scorer.transform(events)
    stream = score_file_stream(spark, scorer, f"{SF_SMALL}/events.parquet")
    cols = ["event_id", "event_type", "value", "type_mean", "value_z", "is_high"]
    assert batch.select(cols).exceptAll(stream.select(cols)).count() == 0
    assert stream.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert stream.filter(F.col("type_mean").isNull()).count() == 0


def test_stream_over_a_folder_of_files(spark, tmp_path):
    events = read_table(spark, SF_SMALL, "events")
    scorer = EventScorer().fit(events)
    folder = str(tmp_path / "events.parquet")
    events.repartition(5).write.parquet(folder)
    stream = score_file_stream(spark, scorer, folder, files_per_batch=2)
    assert stream.count() == events.count()
    assert scorer.transform(events).exceptAll(stream.select("event_id", "event_type", "value", "type_mean", "value_z", "is_high")).count() == 0


def test_rows_filled_one_by_one_equal_the_joined_fill(spark):
    from sparkfeat.operators.knn import KnnImputer
    rows = [(i, float(i % 7) if i % 3 else None, float(i % 5) if i % 4 else None, None if i % 11 == 0 else i / 3) for i in range(120)]
    rows += [(500, None, None, None), (501, float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    knn = KnnImputer(["a", "b", "c"], k=3).fit(df.filter("id < 100"))
    want = {r.id: r for r in knn.transform(df, "id").collect()}
    got = {r.id: r for r in knn.for_rows()(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i][c] - want[i][c]) < 1e-9 for i in want for c in "abc")
    assert knn.for_rows()(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="donors"):
        knn.for_rows(max_donors=5)


def test_row_weights_equal_the_grouped_ones(spark):
    from sparkfeat.operators import text as T
    df = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, ["b", "c"]), (3, []), (4, None), (5, ["unseen"]), (6, ["a", "c", "c"])],
                               "id long, words array<string>")
    vocab = T.fit_tfidf(df.filter("id < 4"), {"words": F.col("words")}, min_df=1, max_features=10)
    want = {(r.id, r.token): r.tfidf for r in T.transform_tfidf(df, "id", {"words": F.col("words")}, vocab).collect()}
    got = {(r.id, r.token): r.tfidf for r in T.row_tfidf(df, "id", {"words": F.col("words")}, vocab).collect()}
    assert got.keys() == want.keys() and {i for i, _ in got} == {1, 2, 6}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_fitted_parts_come_back(spark, tmp_path):
    from sparkfeat.functions.lookup import State, load_fitted, save_fitted
    small = State(spark.range(3).toDF("v"), True)
    large = State(spark.range(5).toDF("v"), False)
    save_fitted(str(tmp_path / "m"), spark, a=small, b=large, c=[1.5, None], d="x\ny", e={"k": [1, 2.0]})
    kept = load_fitted(str(tmp_path / "m"), spark)
    assert sorted(r.v for r in kept["a"].collect()) == [0, 1, 2] and kept["a"].small
    assert not kept["b"].small and kept["b"].df.count() == 5
    assert (kept["c"], kept["d"], kept["e"]) == ([1.5, None], "x\ny", {"k": [1, 2.0]})


def test_family_tags_travel_and_names_fill_in(spark):
    from sparkfeat.operators import text as T
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, plain string, Stage double")
    df = T.tag_family(df.withColumn("odd", F.lit(1)), "4-gram", ["odd"])
    df = df.select("*", F.lit(1).alias("x_TFIDF_4gram"), F.lit(2).alias("my_5Gram"), F.lit(3).alias("log_STAGE"))
    df = df.withColumnRenamed("odd", "renamed").filter("id > 0").select("*")
    got = {r.feature: (r.family, r.tagged) for r in T.feature_families(df, originals=["Stage"]).collect()}
    assert got == {"id": ("Other", False), "plain": ("Other", False), "Stage": ("Original", False), "renamed": ("4-gram", True),
                   "x_TFIDF_4gram": ("TF-IDF", False), "my_5Gram": ("5-gram", False), "log_STAGE": ("Original", False)}
    assert T.feature_families(df, cols=[]).count() == 0
