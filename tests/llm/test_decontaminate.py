"""op10 against brute force over all windows."""

import hashlib
import random
import re

import pytest
from sparkfeat.llm.decontaminate import decontaminate, item_shards

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items, window=10):
    wins = {}
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(name)
    out = []
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for s, own in wins.items():
            for i in range(len(w) - len(s) + 1):
                if tuple(w[i:i + len(s)]) == s:
                    hit |= set(range(i, i + len(s)))
                    names |= own
        ids = sorted(str(x) for x in names if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, rows, items, **more):
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    df = decontaminate(docs, bench, **more)
    got = sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()], key=str)
    return got, {r.doc_id: r.clean_text for r in df.collect()}


@pytest.mark.parametrize("seed,shard", [(1, 10**6), (2, 300)])
def test_random(spark, seed, shard):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "Dé", "e9", "ñ"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "-", "\n"]) for _ in range(n))
    items = [(k, text(rnd.choice([3, 5, 9, 10, 11, 30]))) for k in range(25)] + [(90, None), (91, "..."), (92, ""), (93, "solo"), (None, "null id item"), (93, "other solo text")]
    rows = []
    for d in range(60):
        t = text(rnd.randrange(0, 80))
        if rnd.random() < .7:
            w = words(rnd.choice(items)[1])
            a = rnd.randrange(0, 3)
            t += " ".join(w[a:len(w) - rnd.randrange(0, 3)]).upper() + "; " + text(10)
        rows.append((d, t))
    rows += [(100, None), (101, ""), (102, "--"), (103, "Solo"), (None, "null id item"), (104, rows[1][1]), (104, rows[1][1])]
    got, _ = run(spark, rows, items, shard_bytes=shard)
    assert got == brute(rows, items)


def test_cut_text_and_coverage(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"Start of it. {item.upper()}, the end"), (2, item), (3, "clean words only"), (4, None)]
    got, clean = run(spark, rows, [(1, item)])
    assert got == brute(rows, [(1, item)])
    assert clean == {1: "Start of it. , the end", 2: "", 3: "clean words only", 4: None}


def test_no_items_no_rows_long_text(spark):
    got, _ = run(spark, [(1, "some words")], [])
    assert got == brute([(1, "some words")], [])
    assert run(spark, [], [(1, "a b c")])[0] == []
    rows = [(1, "x y z " * 200_000 + " ".join(f"q{i}" for i in range(10)))]
    got, _ = run(spark, rows, [(1, " ".join(f"q{i}" for i in range(11)))])
    assert got[0][1:4] == (600_010, 10, 1)


def test_shards_are_bounded(spark):
    items = spark.createDataFrame([(i, "w" * 50) for i in range(40)] + [(99, "v" * 500)], "item_id long, text string")
    shards = item_shards(items, "item_id", "text", 200)
    assert sorted(n for s in shards for n, _ in s) == sorted([str(i) for i in range(40)] + ["99"])
    assert all(len(s) == 1 or sum(len(t) for _, t in s) <= 200 for s in shards)


def test_shards_share_equal_items_and_copies(spark):
    """One text under many ids is spread over shards, one row repeated is one item, copies of a document are hit alike."""
    same = " ".join(f"q{i}" for i in range(12))
    items = [(k, same) for k in range(30)] + [(77, "r1 r2 r3")] * 40 + [(88, "q11 tail")]
    shards = list(item_shards(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 150))
    assert sum(len(s) for s in shards) == 32 and len(shards) > 10
    rows = [(d, f"head {same} tail r1 r2 r3") for d in range(50)] + [(60, None), (61, ""), (62, "r1 r2"), (None, "r1 r2 r3")]
    got, clean = run(spark, rows, items, shard_bytes=150, min_span=1)
    assert got == brute(rows, items)
    assert clean[0].split() == ["head"] and clean[60] is None and clean[None] == ""
