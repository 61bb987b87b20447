"""URL filters with a Bloom filter cascade.

A rule is a host and a path; it fits its host and all subdomains when the url's
path starts with the rule's. The keys a url can match are its host suffixes with
its path prefixes up to each "/". Level 1 of the cascade encodes the listed keys;
level 2 the keys of the corpus that pass level 1 without being listed; level 3 the
listed keys that pass level 2; and so on until a level has no false positive left.
Over the corpus's complete key universe the depth at which a key first fails tells
exactly whether it is listed, so urls are judged by bit tests alone, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfeat.llm.common import table

# Largest cascade kept as literals in the plan; beyond it keys are looked up by an equi-join.
MAX_CASCADE_BYTES = 16 << 20
PROBES = 3
BITS_PER_KEY = 24

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, labels: int) -> Column:
    """The host and the parents it is a subdomain of, up to ``labels`` labels (the listed rules have no more)."""
    n = F.least(F.size(F.split(host, r"\.")), F.lit(labels))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function(
        "substring_index", host, F.lit("."), -i))).otherwise(F.array().cast("array<string>"))


def path_prefixes(path: Column, depth: int) -> Column:
    """Prefixes of the path that end with "/", up to ``depth`` of them (the listed rules have no more)."""
    parts = F.split(path, "/")
    n = F.least(F.size(parts) - 1, F.lit(depth))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def candidates(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Keys (host suffix followed by path prefix) that a rule fitting the url could have."""
    return F.flatten(F.transform(host_suffixes(host, labels), lambda h: F.transform(
        path_prefixes(path, depth), lambda p: F.concat(h, p))))


def _bits(key: Column, size: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + k)), F.lit(size)) for k in range(PROBES)]


class Cascade:
    """Bit arrays of the levels; ``holds(key)`` is exact for every key of the universe."""

    def __init__(self, levels: list[tuple[int, list[int]]]):
        self.levels = levels

    def passes(self, key: Column, level: int) -> Column:
        size, words = self.levels[level]
        array = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")     # folded to one literal
        tests = [F.get(array, F.shiftright(b, 6).cast("int")).bitwiseAND(
                     F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))) != 0
                 for b in _bits(key, size, level)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def holds(self, key: Column) -> Column:
        """Fails first at an odd level (1, 3, ...): not listed; at an even one, or never: by the last level."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(~self.passes(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return out


def _level(keys: DataFrame, n: int, level: int) -> tuple[int, list[int]]:
    """Bits of ``n`` keys, combined by word before they reach the driver (size known beforehand)."""
    size = max(64, -(-BITS_PER_KEY * n // 64) * 64)
    rows = (keys.select(F.explode(F.array(*_bits(F.col("key"), size, level))).alias("b"))
            .groupBy(F.shiftright("b", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("bits"))
            .collect())
    words = [0] * (size // 64)
    for r in rows:
        words[r.word] = r.bits
    return size, words


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Cascade of ``listed.key`` over all keys of ``universe.key``; None if it would be too large.

    False positives shrink by orders of magnitude from level to level; only keys
    that pass level 1 are ever made distinct or counted.
    """
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if n * BITS_PER_KEY / 8 * 1.25 > MAX_CASCADE_BYTES:
        return None
    cascade = Cascade([])
    inside, outside = listed, None
    while n:
        level = len(cascade.levels)
        cascade.levels.append(_level(inside, n, level))
        if outside is None:
            passed = universe.select("key").where(cascade.passes(F.col("key"), 0)).distinct()
            outside = passed.join(listed, "key", "left_anti")
        else:
            outside = outside.where(cascade.passes(F.col("key"), level))
        inside, outside = outside, inside          # the next level encodes what passed wrongly
        n = inside.count()
        if sum(s for s, _ in cascade.levels) / 8 + n * BITS_PER_KEY / 8 > MAX_CASCADE_BYTES:
            return None
    return cascade


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict.

    ``rules``: host, path (starting and ending with "/"), verdict (allow or block;
    a key listed both ways is blocked). The longest fitting rule decides (by host,
    then path); without one the url is not listed and gets ``default``. A null url
    or one without "://" has empty host and path and fits no rule. Empty rules:
    every url gets ``default``. Columns of ``pages`` with the new names are replaced.
    """
    rules = rules.where("host is not null and path is not null and verdict is not null").select(
        F.concat(F.lower("host"), "path").alias("key"), "verdict", (F.size(F.split("path", "/")) - 1).alias("depth"),
        F.size(F.split("host", r"\.")).alias("labels"),
        (F.col("path").startswith("/") & F.col("path").endswith("/")).alias("right"))
    labels, depth, right = rules.agg(F.max("labels"), F.max("depth"), F.min("right")).first()
    if right is False:
        raise ValueError("a rule's path must start and end with '/'")
    out = pages.drop("rule", "verdict").withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    keys = candidates(F.col("host"), F.col("path"), labels or 0, depth or 0)
    universe = out.select(F.explode(keys).alias("key"))
    blocked = rules.where("verdict = 'block'").select("key")
    allowed = rules.where("verdict <> 'block'").select("key").join(blocked, "key", "left_anti")
    block, allow = build_cascade(blocked, universe), build_cascade(allowed, universe)
    if block is None or allow is None:
        return _joined(out, rules, keys, default)
    # Longest host suffix first, longest path prefix first within it.
    fits = F.filter(keys, lambda k: block.holds(k) | allow.holds(k))
    longest = F.array_sort(F.transform(fits, lambda k: F.struct((-F.length(F.substring_index(k, "/", 1))).alias("h"),
                                                                (-F.length(k)).alias("l"), k.alias("k"))))
    out = out.withColumn("rule", F.get(longest, 0)["k"])
    verdict = F.when(F.col("rule").isNull(), default).when(block.holds(F.col("rule")), "block").otherwise("allow")
    return out.withColumn("verdict", verdict)


def _joined(out: DataFrame, rules: DataFrame, keys: Column, default: str) -> DataFrame:
    """Lists beyond ``MAX_CASCADE_BYTES``: candidate keys by an equi-join with the list."""
    names = out.columns
    cand = out.withColumn("__row", F.monotonically_increasing_id()).select("*", F.explode_outer(keys).alias("__key"))
    listed = rules.groupBy(F.col("key").alias("__rule")).agg(F.max("verdict").alias("__verdict"))   # block sorts last
    best = F.struct(F.length(F.substring_index("__rule", "/", 1)).alias("h"), F.length("__rule").alias("l"),
                    "__rule", "__verdict")
    grouped = (cand.join(listed, F.col("__key") == F.col("__rule"), "left").groupBy("__row")
               .agg(F.max(F.when(F.col("__rule").isNotNull(), best)).alias("__best"),
                    *[F.first(c).alias(c) for c in names]))
    return grouped.select(*names, F.col("__best.__rule").alias("rule"),
                          F.coalesce("__best.__verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op7_url_cascade(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
         arg_max(v, length(rhost) * 1000 + length(rpath)) AS v
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
