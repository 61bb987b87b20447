"""op13 against brute force; the search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from sparkfeat.llm import ranked as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]


def brute(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        ranked = []
        for i, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, r in asked.items() if t in c)
            if s > 0:
                ranked.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, k=20, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, shard int, Term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, Q int")
    return sorted((tuple(r) for r in R.ranked_search(d, q, k, **more).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "Of", "AND", "a1", "ção", "日本語", "ß", *[f"w{i}" for i in range(60)]]
    return [" .,\n-_"[rng.randrange(6)].join(rng.choices(words, [40, 30, 20, 5, 5, 3, 2, *[1] * 60], k=rng.choice([0, 1, 5, 20, 80])))
            for _ in range(n)]


@pytest.mark.parametrize("more", [{}, {"shard": 9, "block": 4, "first": 2}, {"postings": 50, "first": 1}])
def test_brute_force(spark, more):
    rng = random.Random(2)
    docs = [(rng.choice([None, 5, *range(1000)]), t) for t in corpus(250, 1)] + [(5000, None), (5001, ""), (5002, "-- !"), (5003, "The the THE")]
    items = list(enumerate(corpus(12, 3))) + [(50, None), (51, ""), (52, "nowhere"), (53, "the"), (0, "w1 w2 w1"), (None, "of w7"), (54, docs[3][1])]
    assert run(spark, docs, items, **more) == brute(docs, items, 20)


def test_copies_ties_and_few_rows(spark):
    docs = [(i, "one two three") for i in range(60)] + [(None, "one two")] * 40 + [(7, "one two three")] * 3
    items = [(1, "one three"), (2, "two"), (2, "two")]
    assert run(spark, docs, items, shard=16) == brute(docs, items, 20)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, "a b"), (2, "c")], [(9, "a c")]) == brute([(1, "a b"), (2, "c")], [(9, "a c")], 20)


def test_a_very_long_text(spark):
    docs = [(1, "needle " + "hay " * 200_000), (2, "needle hay"), (3, "x" * 300_000)]
    items = [(1, "needle"), (2, "hay hay needle"), (3, "x" * 300_000)]
    assert run(spark, docs, items) == brute(docs, items, 20)


@pytest.mark.parametrize("dense", [1 << 25, 0])
def test_search_visits_few_documents(monkeypatch, dense):
    monkeypatch.setattr(R, "DENSE", dense)
    rng = np.random.default_rng(0)
    n, log = 8000, []
    docs = [np.sort(rng.choice(n, size, replace=False)) for size in (8000, 3000, 300, 40, 1)]
    impacts = [rng.integers(1, 30 if len(d) < 8000 else 3, len(d)) ** 3 for d in docs]
    weights = [1, 5, 20, 60, 100]
    full = np.zeros(n, np.int64)
    for d, i, w in zip(docs, impacts, weights):
        full[d] += i * w
    order = np.lexsort((np.arange(n), -full))[:20]
    at, score = R.best_documents(R.Lists(docs, impacts, weights, n), 20, log=log)
    assert (at == order).all() and (score == full[order]).all() and log[0] < n / 4
    top = int(full[order[4]])
    at, score = R.best_documents(R.Lists(docs, impacts, weights, n), 20, floor=top)
    assert (at == order[:len(at)]).all() and set(np.flatnonzero(full > top)) <= set(at)
