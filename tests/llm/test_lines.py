"""op8 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import pyarrow as pa
from sparkfeat.llm.lines import _stream_of, apply_bitmaps, line_keep_bitmaps


def key(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return line.strip(" \t\n\x0b\x0c\r")


def brute(rows):
    held = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(held[key(x)]) < 3 or d == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=None):
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, lines int")
    if parts:
        df = df.repartition(parts)
    got = apply_bitmaps(df, line_keep_bitmaps(df), digest=True).select("doc_id", "n_lines", "n_dropped", "__kept")
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    rnd = random.Random(seed)
    pool = [rnd.choice(["ÄÖ", "É", "ab "]) * rnd.randrange(1, 12) + "License Line of words " + str(k) for k in range(30)]
    pool += ["twenty chars exactly", "nineteen chars only", "ü" * 20, "ü" * 19, "short", ""]
    rows = []
    for d in range(200):
        lines = [rnd.choice([str.upper, str.lower, str])(rnd.choice(pool)) if rnd.random() < .5 else f"own line {rnd.random()}"
                 for _ in range(rnd.randrange(0, 12))]
        lines = [rnd.choice(["", " ", "\t\x0b"]) + x + rnd.choice(["", "\r", "  "]) for x in lines]
        rows.append((rnd.randrange(300) if seed == 2 else d, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (None, pool[0]), (None, None), (903, rows[0][1]), (903, rows[0][1])]
    assert run(spark, rows, 5) == brute(rows)


def test_hot_line_over_many_partitions(spark):
    rows = [(d, f"this very common line is everywhere\nown text number {d} of the table") for d in range(3000)]
    rows += [(d, "two documents hold this line\n" * 3) for d in (5000, 5001)]
    assert run(spark, rows, 16) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    rows = [(d, "\n".join(f"line number {k} of a very long text" for k in range(50_000))) for d in range(3)]
    assert run(spark, rows) == brute(rows)


def test_a_line_cut_by_partition_ends():
    """However its sorted rows are cut, the open rows of all parts tell the whole story."""
    docs = [9, 8, 8, 7, 6, 5]
    for cuts in ([1], [2], [3], [4], [5], [1, 2], [3, 5], [1, 2, 3, 4, 5], []):
        edges = [0, *cuts, len(docs)]
        rows = []
        for a, b in zip(edges, edges[1:]):
            part = [(0, 0, 99, 0, [0])] * (a == 0) + [(1, 1, d, 0, [k]) for k, d in enumerate(docs[a:b], a)]
            cols = list(zip(*part))
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h1", "h2", "doc_id", "tk", "lines"])
            for out in _stream_of(3)(iter([batch])):
                rows += out.to_pylist()
        rows = [r for r in rows if r["h1"] == 1]
        opened = [r for r in rows if r["open"]]
        some = [r for r in opened if r["rank"] <= 3]
        assert max([len({r["doc_id"] for r in some}), *(r["seen"] for r in some)]) >= 3
        gone = [r for r in rows if not r["open"]] + [r for r in opened if r["doc_id"] < max(x["doc_id"] for x in some)]
        assert sorted(k for r in gone for k in r["lines"]) == [1, 2, 3, 4, 5]
