"""op3: candidates against a plain scan, held-out accuracy on planted findings, edges."""

import random
import re

from pyspark.sql import functions as F
from sparkfeat.llm.secrets import RUN, candidates, scan_secrets

KEYS = ["token", "api_key", "password", "secret"]


def planted(seed, n):
    rnd = random.Random(seed)
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice("ABCDEFGHabcdefghijkl0123456789+/") for _ in range(k))
    rows, truth = [], set()
    for d in range(n):
        w = ["plain", "words", "here"] * 3
        kind = d % 6
        if kind == 0:
            s = rnd.choice([hexa(40), mixed(32)])
            w += [rnd.choice(KEYS), "=", f'"{s}"']
            truth.add((d, s))
        elif kind == 1:
            w += ["mail", "to", "some.person.with.name" + hexa(2) + "@mail.example.com"]
        elif kind == 2:
            w += ["see", "https://www.example.com/" + hexa(24) + "/page.html"]
        elif kind == 3:
            w += ["averyverylongordinarywordindeed" + rnd.choice("abc")]
        elif kind == 4:
            w += ["number", "1234567890123456" + str(rnd.randrange(10**6, 10**7))]
        rows.append((d, rnd.choice([" ", "\n"]).join(w)))
    return rows, truth


def test_candidates(spark):
    rows, _ = planted(1, 60)
    rows += [(100, None), (101, ""), (None, "x" * 25), (102, "a" * 20 + "!" + "b" * 21), (102, "é" * 30)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, label int")
    got = sorted([(r.doc_id, r.position, r.part, r.candidate) for r in candidates(df).collect()], key=str)
    want = []
    for d, t in rows:
        for i, w in enumerate(re.split(r"[\x20\x09-\x0D]+", t or "")):
            want += [(d, i, k, c) for k, c in enumerate(re.findall(RUN, w))]
    assert got == sorted(want, key=str) and len(got) > 40


def test_false_positives_go_on_unseen_documents(spark):
    rows, _ = planted(2, 600)
    fit = spark.createDataFrame(rows, "doc_id long, text string")
    from sparkfeat.llm.secrets import seed_findings
    findings = seed_findings(candidates(fit))
    new, truth = planted(3, 600)
    got = scan_secrets(spark.createDataFrame(new, "doc_id long, text string"), findings).where("is_secret").collect()
    assert {(r.doc_id, r.candidate) for r in got} == truth


def test_edges(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert scan_secrets(none).count() == 0
    assert scan_secrets(none.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (1, "abcdefghijklmnopqrstuvwxyz"), (2, "w " * 200_000 + "x" * 5000)], "doc_id long, text string")
    got = scan_secrets(one)
    assert got.count() == 3 and got.where(F.col("probability").isNotNull()).count() == 0 and got.where("is_secret").count() == 3


def test_names_before_values_are_neighbours(spark):
    from sparkfeat.llm.secrets import features, seed_findings
    s, h = "Zx81" * 8, "0a1b" * 10
    rows = [(1, f"API_KEY={s}", s), (2, f"AWS_ACCESS_KEY_ID=AKIA{s[:16]}", "AKIA" + s[:16]), (3, f"see https://x.org/a?token={h}&page=2", h)]
    found = candidates(spark.createDataFrame(rows, "doc_id long, text string, want string"))
    assert {(r.doc_id, r.candidate) for r in found.collect()} == {(d, v) for d, _, v in rows}
    assert {r.label for r in seed_findings(found).collect()} == {1}
    assert {(r.key_word, r.assigned) for r in features(found).collect()} == {(1.0, 1.0)}
    assert [r.known_prefix for r in features(found).where("doc_id = 2").collect()] == [1.0]


def assigned(seed, n):
    """Values in the forms of .env lines, URL queries, JSON and code, and what only looks like them."""
    rnd = random.Random(seed)
    pick = lambda k, a="ABCDEFGHabcdefghijkl0123456789": "".join(rnd.choice(a) for _ in range(k - 2)) + "a7"
    rows, truth = [], set()
    for d in range(n):
        s, h = pick(32), pick(40, "0123456789abcdef")
        short, odd = pick(rnd.choice([8, 12, 16])), pick(5) + rnd.choice("!$%~#@") + pick(6) + "!" + pick(9)
        word, value = [
            (f"API_KEY={s}", s), (f"https://x.org/a?token={h}&page=2", h), (f"password = {short}", short), (f'"db_password":"{odd}",', odd),
            (f"DB_PASSWORD={short}", short), (f"token: {odd}", odd), (f"AWS_ACCESS_KEY_ID=AKIA{s[:16]}", "AKIA" + s[:16]),
            (f"Server=db;Password={short};User=me", short), (f"secret ={short}", short), (f"export GITHUB=ghp_{s}", "ghp_" + s),
            (f"https://www.example.com/{pick(24)}/page.html", None), ("password=${DB_PASSWORD_OF_HOST}", None),
            (f"mail some.person.with.name{pick(2)}@mail.example.com", None), ("token: placeholder", None), (f"number 12345678901234567{rnd.randrange(999)}", None),
            ("averyverylongordinarywordindeed", None)][d % 16]
        rows.append((d, rnd.choice([" ", "\n"]).join(["plain", "words", word, "here"])))
        if value:
            truth.add((d, value))
    return rows, truth


def test_assigned_values_are_candidates(spark):
    rows, truth = assigned(1, 160)
    got = {(r.doc_id, r.candidate) for r in candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert truth <= got and not [c for _, c in got if re.search("(?i)^(api_key|token|password)=", c)]
    keep = [(1, "f" * 30 + "=" + "0a" * 15), (2, "secrets=[" + "0a" * 15 + "," + "1b" * 15 + "]"), (3, "password=" + "a1" * 20_000), (4, "a_long_setting_name=on"),
            (5, "author: B. Long"), (6, "x" * 30 + "=="), (7, "token=token=abc"), (8, "API_KEY=x")]
    got = sorted((r.doc_id, r.candidate) for r in candidates(spark.createDataFrame(keep, "doc_id long, text string")).collect())
    assert (2, "0a" * 15) in got and (2, "1b" * 15) in got and (3, "a1" * 20_000) in got and (4, "a_long_setting_name=on") in got
    assert (6, "x" * 30 + "==") in got and not [c for d, c in got if d in (5, 8)]


def test_assigned_secrets_stay_on_unseen_documents(spark):
    from sparkfeat.llm.secrets import seed_findings
    fit, _ = assigned(2, 800)
    new, truth = assigned(3, 800)
    findings = seed_findings(candidates(spark.createDataFrame(fit, "doc_id long, text string")))
    got = scan_secrets(spark.createDataFrame(new, "doc_id long, text string"), findings).where("is_secret").collect()
    assert {(r.doc_id, r.candidate) for r in got} == truth
