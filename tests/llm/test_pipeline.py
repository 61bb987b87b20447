"""Every pipeline stage against a brute-force version on its own input."""

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F
from sparkfeat.llm.common import materialize, table
from sparkfeat.llm.mixing import WEIGHTS
from sparkfeat.llm.quality import op9_quality_gam

from tests.conftest import SF_SMALL
from tests.llm import test_decontaminate as leaks, test_lines as line, test_mixing as mix, test_simhash as sim


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF_SMALL, "documents")]
    for name, stage in cp.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF_SMALL), "test"))
    return docs


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_drops_what_is_rejected(spark, steps):
    bad = {r.doc_id for r in op9_quality_gam(spark, SF_SMALL).where("predicted = 0").collect()}
    assert rows(steps[1]) == [r for r in rows(steps[0]) if r[0] not in bad]


def test_lines(steps):
    before = rows(steps[1])
    held = {}
    for d, t in before:
        for x in t.split("\n"):
            held.setdefault(line.key(x), set()).add(d)
    drop = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    want = [(d, "\n".join(x for x in t.split("\n") if drop.get(line.key(x), d) == d)) for d, t in before]
    assert rows(steps[2]) == want


def test_one_of_each_group_stays(steps):
    before = rows(steps[2])
    stay = {d for d, _, c in sim.brute(before) if d == c}
    assert rows(steps[3]) == [r for r in before if r[0] in stay]


def test_leaks_go(spark, steps):
    before, items = rows(steps[3]), [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    judged = {r[0]: r for r in leaks.brute(before, items)}
    after = dict(rows(steps[4]))
    assert set(after) == {d for d, _ in before if judged[d][2] <= 0.5 * judged[d][1]}
    for d, t in before:
        if d in after:
            assert len(leaks.words(after[d])) == judged[d][1] - judged[d][2]
            assert judged[d][2] or after[d] == t


def test_mixture(steps):
    data = [(r.doc_id, r.text, r.domain, r.lang, r.source) for r in steps[4].withColumn("domain", cp.domain_of(F.col("source"))).collect()]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in data)
    got = [(r.doc_id, r.domain, r.lang, r.source, r.epoch, r.take_tokens) for r in steps[5].collect()]
    assert sorted(got, key=str) == mix.brute(data, total // 2, WEIGHTS, 4, 2024)
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.take_tokens for r in steps[5].collect())


def test_odd_input(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "src0", 0), (2, "", None, None, None), (None, "some text", "en", "src1", 9),
                                  (3, "plain words in a text", "en", "src1", 21), (3, "plain words in a text", "en", "src1", 21)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("__score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() >= 0
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_rows_without_or_with_shared_ids_stay(spark):
    """One row of every group, by row: neither a missing nor a repeated doc_id costs a group."""
    base = {k: " ".join(f"{k}{i * 7 % 50}" for i in range(60)) for k in "abcdefg"}
    data = [(3, base["a"], "en", "src1"), (7, base["a"] + " x", "en", "src1"), (7, base["b"], "en", "src1"),
            (7, base["c"], "de", "src2"), (None, base["d"], "en", "src1"), (None, base["d"], "en", "src1"),
            (None, base["e"], None, "src1"), (None, base["a"], "en", "src2"), (8, base["f"], "en", None),
            (9, base["f"], "en", None), (9, base["g"], "en", "src0"), (9, base["g"], "src0", "en")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted([(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect()], key=str)
    groups = {}
    for i, _, low in sim.brute([(i, r[1]) for i, r in enumerate(data)]):      # numbered rows: one id each
        groups.setdefault(low, []).append(data[i][:2])
    assert len(groups) == 7
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    assert got == sorted(want, key=str)
    again = cp.near_dedup(spark, docs.repartition(5, "text"), "").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, cp.near_dedup(spark, docs, "").collect()), key=str)

