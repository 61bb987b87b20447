"""op5 against a direct computation with fractions and sorted epochs."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from sparkfeat.llm import mixing
from sparkfeat.llm.mixing import LEVELS, WEIGHTS, mix_sources


def fill(budget, kids):
    """kids: name -> (cap, weight); shares by repeated redistribution, whole tokens."""
    budget = min(budget, sum(c for c, w in kids.values() if w))
    full, left = {}, budget
    while True:
        open_ = {k: v for k, v in kids.items() if k not in full and v[1]}
        total = sum(w for _, w in open_.values())
        new = {k: c for k, (c, w) in open_.items() if Fraction(left * w, total) >= c}
        if not new:
            break
        full.update(new)
        left = budget - sum(full.values())
    parts = {k: left * w // total for k, (_, w) in open_.items()}
    for k in sorted(parts)[:left - sum(parts.values())]:
        parts[k] += 1
    return {k: full.get(k, parts.get(k, 0)) for k in kids}


def brute(rows, budget, weights, max_epochs, seed):
    leaf = defaultdict(list)
    for d, t, dom, lang, src in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if n:
            leaf[tuple(x or "(none)" for x in (dom, lang, src))].append((d, n, t))
    w = lambda level, k: weights.get(level, {}).get(k, 1)
    cap = {k: sum(n for _, n, _ in v) * max_epochs * all(w(*x) for x in zip(LEVELS, k)) for k, v in leaf.items()}
    out = []
    doms = fill(budget, {d: (sum(c for k, c in cap.items() if k[0] == d), w("domain", d)) for d in {k[0] for k in cap}})
    for d, b in doms.items():
        langs = fill(b, {x: (sum(c for k, c in cap.items() if k[:2] == (d, x)), w("lang", x)) for x in {k[1] for k in cap if k[0] == d}})
        for x, b2 in langs.items():
            for s, got in fill(b2, {k[2]: (c, w("source", k[2])) for k, c in cap.items() if k[:2] == (d, x)}).items():
                docs, epoch = leaf[d, x, s], 0
                while got > 0:
                    key = lambda r: (int(hashlib.md5(f"{seed}:{epoch}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16), r[0] or 0)  # noqa: B023, E731
                    for doc, n, _ in sorted(docs, key=key):
                        if got > 0:
                            out.append((doc, d, x, s, epoch, min(n, got)))
                            got -= n
                    epoch += 1
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, domain string, lang string, source string, epoch double")
    got = mix_sources(df, F.col("domain"), **more)
    return sorted([tuple(r) for r in got.select("doc_id", "domain", "lang", "source", "epoch", "take_tokens").collect()], key=str)


def rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        src = "src0" if rnd.random() < .4 else f"src{rnd.randrange(1, 7)}"
        out.append((d, "w " * int(rnd.paretovariate(1)), rnd.choice(["web", "books", None]), rnd.choice(["en", "en", "en", "de", None]), src))
    return out + [(900, None, "web", "en", "src0"), (901, " \n", "web", "en", "src0"), (902, "tiny leaf", "solo", "xx", "one"), (None, "no id here", "solo", "yy", None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("exact", [4096, 3])
def test_budgets(spark, monkeypatch, seed, exact):
    monkeypatch.setattr(mixing, "EXACT_ROWS", exact)          # small: several radix rounds
    data = rows(seed)
    budget = [37, 700, 4000][seed - 1]
    weights = WEIGHTS if seed < 3 else {"domain": {"web": 3, "solo": 0}, "source": {"src2": 9, "src3": 0}}
    got = run(spark, data, budget=budget, weights=weights, max_epochs=3)
    assert got == brute(data, budget, weights, 3, 2024)


def test_share_and_everything(spark):
    data = rows(5)
    total = sum(len((t or "").split()) for _, t, *_ in data)
    assert run(spark, data, budget_share=0.5) == brute(data, total // 2, WEIGHTS, 4, 2024)
    assert sum(r[-1] for r in run(spark, data, budget=10**9, max_epochs=2)) == 2 * total
    assert run(spark, data, budget=0) == []
    assert run(spark, []) == []


def test_repeated_rows_and_long_text(spark):
    data = [(1, "a b c d", "web", "en", "s")] * 3 + [(2, "x " * 300_000, "books", "en", "s")]
    got = run(spark, data, budget=20, weights={"domain": {"web": 1, "books": 1}}, max_epochs=1)
    assert sorted(r[-1] for r in got) == [2, 4, 4, 10]       # 20 of 20 tokens: whole copies first, one is cut


@pytest.mark.parametrize("budget", [33, 40, 45, 50, 53, 61, 110, 120, 153])
@pytest.mark.parametrize("doc_id", [7, None])
def test_copies_at_the_cut_lose_no_token(spark, budget, doc_id):
    data = [(doc_id, "a b c d e", "web", "en", "s")] * 10 + [(8, "k l m n o p q r s t", "web", "en", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, domain string, lang string, source string")
    got = mix_sources(df, F.col("domain"), budget=budget, max_epochs=4).collect()
    assert sum(r.take_tokens for r in got) == budget
    assert sum(r.take_tokens < r.n_tokens for r in got) <= 1
    assert all(len(r.text.split()) == r.take_tokens for r in got)


def test_many_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EXACT_ROWS", 8)             # the cut is searched among rows spread by their texts
    data = [(None, f"t{k} word", "web", "en", "s") for k in range(400)]
    got = run(spark, data, budget=301, max_epochs=1)
    assert sum(r[-1] for r in got) == 301 and sorted(r[-1] for r in got) == [1] + [2] * 150
