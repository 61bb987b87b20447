"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor
kept; ``run`` writes every stage's result as Parquet in the shared checkpoint folder
and reads it back as the next stage's input. All but the last return the columns of
``documents`` (n_chars follows the text). Defined for odd input: null and empty texts
pass the text stages unchanged; the near-duplicate stage keeps one row of every group,
also where rows have no doc_id or share one with other texts; an empty table gives an
empty result; other columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm.common import drop_materialized, materialize, table
from sparkfeat.llm.decontaminate import decontaminate
from sparkfeat.llm.lines import apply_bitmaps, line_keep_bitmaps
from sparkfeat.llm.mixing import domain_of, mix_sources
from sparkfeat.llm.quality import score_quality, train_quality
from sparkfeat.llm.simhash import near_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
QUALITY_THRESHOLD = 0.7
MAX_COVERAGE = 0.5      # share of a document's words inside benchmark windows beyond which it goes


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score under 0.7)."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).where(F.col("__score") >= QUALITY_THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines of 20 characters or more that three documents hold, but for the largest doc_id."""
    docs = docs.select(*COLUMNS)
    kept = apply_bitmaps(docs, line_keep_bitmaps(docs))
    return _documents(kept.withColumnRenamed("__kept", "text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: the smallest doc_id (null last), of its rows the smallest row hash.

    The row hash is of all columns, so rows that share a doc_id but differ stay apart and
    the choice is the same in every run; of fully equal rows one stays.
    """
    parts = [*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)]
    keyed = docs.select(*COLUMNS, *(F.xxhash64(F.lit(k), *parts).alias(f"__row{k}") for k in (0, 1)))
    rows = ["__row0", "__row1"]
    groups = near_groups(keyed, shingle=4, radius=4, keep=tuple(rows))
    stay = (groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *rows)).alias("r"))
            .select(*(F.col(f"r.{c}").alias(c) for c in rows)))
    return keyed.join(stay, rows).dropDuplicates(rows).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages of 10 words or more; documents mostly made of them go."""
    judged = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10, min_span=1,
                           max_coverage=MAX_COVERAGE)
    return _documents(judged.where("not over_coverage").withColumn("text", F.col("clean_text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, in the weights of the domain-language-source tree."""
    return mix_sources(docs, domain_of(F.col("source")))


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("mixing sources", mixture)]

# The classifier and the SimHash cannot be written in SQL: tests/llm/test_pipeline.py holds
# every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            drop_materialized(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
