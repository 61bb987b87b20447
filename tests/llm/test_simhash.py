"""op6 against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from sparkfeat.llm.simhash import compare_groups, linked_edges, near_duplicates
from sparkfeat.llm.components import components


def brute(rows, radius=4):
    fps = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    low = group_min([d for d, _ in rows], fps, radius)
    return sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, low)), key=str)


def group_min(ids, fps, radius):
    n = len(fps)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                label[find(i)] = find(j)
    roots = [find(i) for i in range(n)]
    return [min((ids[k] for k in range(n) if roots[k] == r and ids[k] is not None), default=None) for r in roots]


def test_documents(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["Aé", "b", "zz"]) + str(rnd.randrange(300))
    rows = []
    for d in range(60):
        w = [word() for _ in range(rnd.randrange(0, 200))]
        rows.append((3 * d, " ".join(w)))
        for k in range(rnd.randrange(0, 3)):
            v = list(w)
            if v:
                v[rnd.randrange(len(v))] = word()
            rows.append((1000 + 3 * d + k, rnd.choice([" ", "\n", "\t\x0b"]).join(v)))
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "one TWO"), (7004, "ONE two"), (None, "one two"),
             (None, "alone here"), (7005, "a b c d"), (7005, "a b c d"), (7006, "x " * 100_000)]
    df = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted([tuple(r) for r in near_duplicates(df).collect()], key=str)
    assert got == brute(rows)


def test_hot_groups_and_every_radius(spark):
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for _ in range(1500)}
    fps |= {rnd.getrandbits(64) for _ in range(300)}
    fps |= {f ^ sum(1 << b for b in rnd.sample(range(64), 5)) for f in list(fps)[:50]}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in (1, 3, 4):
        label = {r.v: r.label for r in components(linked_edges(df, radius)).collect()}
        got = [label.get(x, x) for x in signed]
        assert got == group_min(signed, fps, radius)


def test_compare_groups_sides():
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0x3FF)
    for side in (np.full(300, -1), np.repeat([0, 1], 150), rnd.integers(0, 2, 300)):
        a, b = compare_groups(fps, side, np.zeros(300, int), list(range(64)), 1)
        got = dict(zip(a.tolist(), b.tolist()))
        label = list(range(300))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x
        for i in range(300):
            for j in range(i):
                if bin(int(fps[i] ^ fps[j])).count("1") <= 1 and (side[i] == -1 or side[i] != side[j]):
                    p, q = find(i), find(j)
                    label[max(p, q)] = min(p, q)
        assert [got.get(i, i) for i in range(300)] == [find(i) for i in range(300)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
