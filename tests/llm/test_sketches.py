"""op11 against brute force and its own laws."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sparkfeat.llm import sketches as S

LIMIT = 2 ** 64 // 8


def plain_sketch(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    values = {int(hashlib.md5(s.encode()).hexdigest()[:16], 16) for s in shingles}
    return {v for v in values if v < LIMIT} or set(sorted(values)[:1])


def like(a, b):
    return float(len(a) == len(b)) if not a or not b else len(a & b) / min(len(a), len(b))


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    stands = {i: min(t or "" for j, t in rows if j == i) for i in ids}
    out = []
    for i, t in rows:
        t = t or ""
        after = t if i is None else stands[ids[ids.index(i) - 1]]
        k = len(t) // 3
        e = t[:len(t) - k] + after[:k]
        own, ed, nx = plain_sketch(t), plain_sketch(e), plain_sketch(after)
        mark = lambda s: "".join(f"{v:016x}" for v in sorted(s))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(own), mark(ed), like(own, ed), like(own, nx)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, part int, lane string, Doc_Count int")
    return sorted((tuple(r) for r in S.edited_likeness(df.repartition(3), **more).collect()), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["Ab", "ção", "ß", "straße", "e", "日本", "zz", "\x0bq", " ", "😀"]
    return [" \t\n"[rng.randrange(3)].join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 30, 400]))) for _ in range(n)]


@pytest.mark.parametrize("lane_rows", [1000, 2])
def test_brute_force(spark, lane_rows):
    rng = random.Random(5)
    rows = [(rng.choice([None, 7, -3, 2 ** 62, *range(100, 140)]), t) for t in texts(90)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "same words here"), (503, "same words here"), (7, "x " * 20_000)]
    assert run(spark, rows, lane_rows=lane_rows) == brute(rows)


@pytest.mark.parametrize("hot", [None, 5])
def test_a_third_of_the_rows_share_an_id(spark, hot):
    rows = [(hot, "one two three four five six")] * 60 + list(enumerate(texts(60, 2)))
    assert run(spark, rows, lane_rows=10) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    for rows in ([(1, "a b c d e f")], [(None, "abc def")], [(1, None)], [(1, "abcdef"), (2, "x")], [(1, "abc")] * 3):
        assert run(spark, rows) == brute(rows)


def test_fingerprints_merge_and_compare(spark):
    rows = [(1, "g", " ".join(f"w{i}" for i in range(300))), (2, "g", " ".join(f"w{i}" for i in range(200, 900))),
            (3, "h", "two words"), (4, "h", "three more words"), (5, "e", None), (6, None, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, grp string, text string")
    marks = S.fingerprints(df).join(df.select("doc_id", "grp"), "doc_id")
    got = {r.grp: r.fingerprint for r in S.merge_fingerprints(marks, "grp").collect()}
    every = {g: set().union(*({int(hashlib.md5(" ".join(t.split()[i:i + 5]).encode()).hexdigest()[:16], 16)
                               for i in range(max(1, len(t.split()) - 4))} for _, h, t in rows if h == g and t)) for g in got}
    want = {g: "".join(f"{v:016x}" for v in sorted({v for v in s if v < LIMIT} or set(sorted(s)[:1]))) for g, s in every.items()}
    assert got == want
    pairs = marks.alias("a").join(marks.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    for r in pairs.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"),
                          S.likeness_of(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("v")).collect():
        a, b = (plain_sketch(rows[k - 1][2]) for k in (r.x, r.y))
        assert r.v == like(a, b)


def test_containment_of_unequal_texts():
    words = [f"w{i}" for i in range(20_000)]
    small, large = S.sketch(" ".join(words[3000:5000])), S.sketch(" ".join(words))
    assert S.likeness(small, large) == 1.0 and 0.08 < len(small) / len(large) < 0.12
    half = S.sketch(" ".join(words[4000:5000] + [f"v{i}" for i in range(1000)]))
    assert abs(S.likeness(half, large) - 0.5) < 0.1
