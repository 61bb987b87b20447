"""Columns of the input that are named like an operator's own, in any case."""

import numpy as np
from pyspark.sql import functions as F
from sparkfeat.llm.decontaminate import OUT, decontaminate
from sparkfeat.llm.lines import apply_bitmaps, line_keep_bitmaps
from sparkfeat.llm.quality import fit, score_quality, FEATURES
from sparkfeat.llm.topk import top_k

LINE = "this line is long enough to count"


def frame(spark, *extra):
    df = spark.createDataFrame([(i, f"{LINE}\nown {i}") for i in range(4)], "doc_id long, text string")
    return df.select("*", *[F.lit(f"mine{i}").alias(c) for i, c in enumerate(extra)])


def test_line_bitmaps(spark):
    docs = frame(spark, "keep", "N_lines", "n_Dropped", "__TEXT", "__kept", "tk", "__id", "a.b")
    out = apply_bitmaps(docs, line_keep_bitmaps(docs))
    assert out.columns == ["doc_id", "keep", "__TEXT", "tk", "__id", "a.b", "n_lines", "n_dropped", "__kept"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0]["__kept"] == "own 0" and rows[0].n_dropped == 1 and rows[3]["__kept"] == f"{LINE}\nown 3"
    assert rows[0].keep == "mine0" and rows[0]["__TEXT"] == "mine3" and rows[0]["a.b"] == "mine7"


def test_quality_scores(spark):
    model = fit(np.zeros((4, len(FEATURES))), np.array([0.0, 1.0, 0.0, 1.0]))
    out = score_quality(frame(spark, "__Score", "__text", "__k0"), model)
    assert out.columns == ["doc_id", "text", "__text", "__k0", "__score"]
    for r in out.collect():
        assert r["__text"] == "mine1" and r["__k0"] == "mine2" and r.text.startswith(LINE) and 0 <= r["__score"] <= 1


def test_decontamination(spark):
    items = spark.createDataFrame([(1, LINE)], "item_id long, text string")
    out = decontaminate(frame(spark, "__hits", "N_HIT", "__text", "Clean_Text", "x"), items)
    assert out.columns == ["doc_id", "__hits", "__text", "x", *OUT]
    for r in out.collect():
        assert r.n_hit == 7 and r["__hits"] == "mine0" and r["__text"] == "mine2" and r.x == "mine4"


def test_a_repeated_query_id_has_one_answer_in_any_layout(spark):
    """The smallest of the shortest vectors is searched."""
    rows = [(20, [5.0, 0.0]), (20, [0.0, 5.0]), (20, [0.0, 1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.0, 1.0]), (23, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = None
    for parts in (1, 2, 3, 6):
        for layout in (df.repartition(parts), df.orderBy(F.desc("embedding")).coalesce(parts)):
            got = sorted(tuple(r) for r in top_k(layout, F.col("vec_id") % 20 == 0, 2).collect())
            want = want or got
            assert got == want == [(20, 1, 22, 20480), (20, 2, 23, 10240)]
