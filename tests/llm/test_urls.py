"""op7 against plain rule matching."""

import random

import pytest
from pyspark.sql import functions as F
from sparkfeat.llm import urls
from sparkfeat.llm.urls import RULES, build_cascade, judge_urls, rule_table


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(rows, rules):
    out = []
    for i, u in rows:
        host, path = parse(u)
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best[2] if best else None, best[3] if best else "allow"))
    return sorted(out, key=str)


def rows():
    rnd = random.Random(2)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "a.b.net", "net", "com", "xcom", "exampleXcom", "", "a.example.org:80", "ünï.com"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "/es/1", "/fr/", "/EN/", "//en/", "/de/en/"]
    out = [(k, rnd.choice(["http", "https", "", "a b\n"]) + "://" + rnd.choice(hosts) + rnd.choice(paths) + rnd.choice(["", "?q=/en/", "#/es/", "?a://b"])) for k in range(400)]
    return out + [(900, None), (901, ""), (902, "example.com/en/"), (903, "http://x://example.com/en/"), (904, "http://com/" + "y/" * 20_000), (None, "http://net/es/"), (905, out[0][1]), (905, out[0][1])]


@pytest.mark.parametrize("limit", [urls.MAX_CASCADE_BYTES, 0])
def test_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "MAX_CASCADE_BYTES", limit)
    df = spark.createDataFrame([(i, u, 1) for i, u in rows()], "page_id long, url string, verdict int")
    got = judge_urls(df, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows(), RULES)


def test_cascade_is_exact_with_many_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 3)          # a poor filter needs many levels
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'")
    cascade = build_cascade(listed, universe)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.holds(F.col("key")) != F.col("key").endswith("7"))
    assert wrong.count() == 0


def test_no_rules_no_pages_and_bad_rules(spark):
    df = spark.createDataFrame([(1, "http://com/")], "page_id long, url string")
    none = rule_table(spark, [("com", None, "block")])
    assert [tuple(r) for r in judge_urls(df, none).collect()] == [(1, "http://com/", "com", "/", None, "allow")]
    assert judge_urls(df.limit(0), rule_table(spark)).count() == 0
    both = rule_table(spark, [("com", "/", "allow"), ("com", "/", "block")])
    assert judge_urls(df, both).first().verdict == "block"
    with pytest.raises(ValueError):
        judge_urls(df, rule_table(spark, [("com", "/en", "block")]))


def test_host_of_many_labels(spark):
    rules = rule_table(spark, [*RULES, ("a.b.c.d.net", "/es/x/", "allow")])
    hosts = ["a." * 20_000 + "net", "a.b.c.d.net", "z.a.b.c.d.net", "b.c.d.net", ".net", "net.", "..", "a." * 20_000 + "org"]
    data = [(k, f"http://{h}/es/x/y") for k, h in enumerate(hosts)]
    df = spark.createDataFrame(data, "page_id long, url string")
    sizes = df.select(F.size(urls.host_suffixes(urls.host_of(F.col("url")), 5)).alias("n")).agg(F.max("n")).first()[0]
    assert sizes == 5
    got = judge_urls(df, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(data, [*RULES, ("a.b.c.d.net", "/es/x/", "allow")])
