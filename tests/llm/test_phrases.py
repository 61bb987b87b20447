"""op2 against a brute-force count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from sparkfeat.llm import phrases
from sparkfeat.llm.phrases import remove_repeated_phrases


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window=35):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows],
                               "doc_id long, text string, anchor string, n int")
    got = remove_repeated_phrases(df, window=window).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted([tuple(r) for r in got], key=str)


def passages(seed, docs=40, vocab=4000):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["é", "ß", "x", "Ü"]) + str(rnd.randrange(vocab))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 80, 120)]
    rows = []
    for d in range(docs):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            w += [word() for _ in range(rnd.randrange(0, 60))]
            p = rnd.choice(shared)
            a = rnd.randrange(0, 3) * rnd.randrange(0, 20)
            w += p[a:len(p) - rnd.choice([0, 0, 3, 11])]
        rows.append((d, rnd.choice([" ", "\n", " \t", "\x0b "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_passages(spark, seed):
    rows = passages(seed)
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, None), (103, ""), (104, " \n "),
             (105, "a " * 80), (106, "a b " * 30), (107, " ".join("abcdefg") * 20), (108, rows[5][1][:900])]
    assert run(spark, rows) == brute(rows)


def test_small_window_and_repeats_in_one_document(spark):
    rnd = random.Random(9)
    rows = [(d, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 60)))) for d in range(25)]
    assert run(spark, rows, window=9) == brute(rows, window=9)


def test_null_ids_repeated_rows_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(1, t), (1, t), (None, t + " z"), (None, "short"), (2, " ".join(f"v{i}" for i in range(60))), (2, "other")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_long_text(spark):
    w = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[1000:1050])), (3, "no")]
    assert run(spark, rows) == brute(rows)


def test_rows_with_one_first_hash_stay_apart(spark, monkeypatch):
    """Different documents whose first 64 bits collide keep their own runs."""
    monkeypatch.setattr(phrases, "_row_key", lambda: (F.pmod(F.col("doc_id"), F.lit(2)).alias("uid"),
                                                      F.xxhash64(F.lit(1), "doc_id", "text").alias("tag")))
    rows = passages(4)
    assert run(spark, rows) == brute(rows)
