"""Secret scans: a random forest that removes false positives.

Candidates are long runs of key characters in any text, and the values of 6 characters
or more that are assigned (= or :) to a key word, of any characters up to white space or
the closing quote. A name and = before a candidate (NAME=value, ?token=value) belong to
the words next to it. Each candidate is described by its length, its character-class transitions, how much of it dictionary words cover,
whether it stands in a path or address, and the words next to it. A random forest
trained on labelled findings gives the probability that a candidate is a secret;
candidates below the threshold are dropped as false positives.

Only DataFrame functions and Spark ML; texts are read once for candidates, which
are all that is shuffled or kept.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfeat.llm.common import materialize, table

MIN_LENGTH = 20          # of a run anywhere
MIN_VALUE = 6            # of a value assigned to a key word
RUN = r"[A-Za-z0-9+/_=.\-]{20,}"
WHITE_RUN = r"[\x20\x09-\x0D]+"
# Words that make a candidate look like an ordinary name rather than a key.
DICTIONARY = ["example", "sample", "test", "dummy", "placeholder", "changeme", "your", "here", "public", "default",
              "config", "version", "release", "build", "index", "image", "static", "assets", "docs", "mail", "http", "https",
              "www", "html", "json", "data", "user", "name", "page", "file", "the", "and", "that", "with", "from", "this",
              "tion", "ing", "ent", "und", "der", "die", "que", "les", "ment", "ción", "keit", "lich", "schaft"]
# Neighbouring words of keys, and of digests and names that only look like keys.
KEYS = "token|secret|passw|pwd|api_?-?key|access_?-?key|private|credential|bearer|auth"
KEY_WORDS = f"(?i)({KEYS})"
OTHER_WORDS = r"(?i)(sha-?[0-9]|md5|checksum|digest|commit|hash|uuid|guid|version|build|etag|integrity|session|page|id$)"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk-|sk_live_|pk_live_|rk_live_|AIza|SG\.|npm_|pypi-|eyJ)"

ASSIGN = r"(?:=>|:=|=+|:(?!//|:))"
NAMED = rf"[\w./+\-]{{0,64}}?(?i:{KEYS})[\w.\-]{{0,64}}[\"'`\])]{{0,2}}{ASSIGN}"       # a name with a key word, and its sign
# An unquoted value ends before another name=value, or another run of a list.
OPEN = rf"(?:(?!&[\w.\-]+=|[,;|](?:[\w.\-]+[=:]|{RUN}))[^\"'`])"
FIND = (rf"(?:{NAMED})+(?:\"[^\"]{{{MIN_VALUE},}}+|'[^']{{{MIN_VALUE},}}+|`[^`]{{{MIN_VALUE},}}+|{OPEN}{{{MIN_VALUE},}}+)|{RUN}")
# What is cut off a match and joins the words before: names with their signs, but never a run that may be a key itself.
NAME = r"(?:[\w./+\-]{1,19}|[A-Za-z_./\-]{20,64})="
LEAD = rf"^((?:{NAME})?(?:{NAMED})+[\"'`]?(?=.{{{MIN_VALUE}}})|{NAME}(?=[^=].{{{MIN_VALUE - 1}}}))"
SPACED = rf"(?i)(?:{KEYS})[^\x20=:]{{0,64}}\x20?{ASSIGN}$"                            # before a value that is a word of its own
# Assigned values that are no keys: variables, calls, words that stand for one.
STANDS_FOR = r"(?i)^(?:\$[{(a-z_]|%[({s]|\{\{|[a-z_.]+\()|^[^0-9]*(example|sample|test|dummy|placeholder|changeme|your|here|public|default|string|none|null|true|false|required|optional)[^0-9]*$"

FEATURES = ["length", "class_changes", "changes_per_char", "digit_share", "upper_share", "lower_share", "mark_share",
            "hex_only", "distinct_share", "coverage", "vowel_share", "longest_letters", "in_path", "in_address", "known_prefix",
            "assigned", "quoted", "key_word", "other_word"]


def _share(candidate: Column, drop: str) -> Column:
    return 1 - F.length(F.regexp_replace(candidate, drop, "")) / F.length(candidate)


def features(df: DataFrame) -> DataFrame:
    """Add the ``FEATURES`` of columns candidate, before (two words, and its name in the word), word (the whole word it stands in)."""
    c = F.col("candidate")
    kinds = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-",
                        "A" * 26 + "a" * 26 + "0" * 10 + "-" * 6)
    runs = F.regexp_replace(F.regexp_replace(kinds, "[^Aa0]", "-"), r"(.)\1+", "$1")
    near = F.concat_ws(" ", F.col("before"), F.col("word"))
    head = F.call_function("substring_index", F.col("word"), c, F.lit(1))
    truth = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return df.select(
        "*", F.length(c).cast("double").alias("length"), (F.length(runs) - 1).cast("double").alias("class_changes"),
        ((F.length(runs) - 1) / F.length(c)).alias("changes_per_char"), _share(c, "[0-9]").alias("digit_share"),
        _share(c, "[A-Z]").alias("upper_share"), _share(c, "[a-z]").alias("lower_share"), _share(c, "[^A-Za-z0-9]").alias("mark_share"),
        truth(c.rlike(r"^[0-9a-fA-F]+$")).alias("hex_only"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct_share"),
        _share(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True))).alias("coverage"),
        _share(F.lower(c), "[aeiou]").alias("vowel_share"),
        F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)).cast("double").alias("longest_letters"),
        truth(F.col("word").rlike(r"(://|^[./~]*/|[A-Za-z]:\\|/[^/]+/)")).alias("in_path"), truth(F.col("word").contains("@")).alias("in_address"),
        truth(c.rlike(PREFIXES)).alias("known_prefix"),
        truth(near.rlike(r"[=:]\s*[\"']?\S*$") & (F.col("before").rlike(r"[=:]$") | head.rlike("[=:]"))).alias("assigned"),
        truth(head.rlike("[\"'`]$")).alias("quoted"),
        truth(F.concat_ws(" ", F.col("before"), head).rlike(KEY_WORDS)).alias("key_word"),
        truth(F.concat_ws(" ", F.col("before"), head).rlike(OTHER_WORDS)).alias("other_word"))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, position (word number from 0), part (within the word), candidate, word, before.

    before: the two words before, and the name with its sign that precedes the candidate in its word.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), WHITE_RUN)

    def lead(w, i):
        """What makes the word read as a value assigned to a key word before it; empty if it is none."""
        one, two = F.get("w", i - 1), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1))
        return (F.when(one.rlike("[=:>]$") & two.rlike(SPACED), "password=")
                .when(w.rlike("^[=:]") & one.rlike(rf"(?i)(?:{KEYS})[^\x20=:]{{0,64}}$"), "password").otherwise(""))

    def wanted(w, i):
        return ((F.length(w) >= MIN_LENGTH) & w.rlike(RUN)) | (
            (F.length(w) >= MIN_VALUE) & (w.rlike("[=:]") | F.get("w", i - 1).rlike("[=:>]$")) & F.concat(lead(w, i), w).rlike(FIND))

    found = F.filter(F.transform("w", lambda w, i: F.when(wanted(w, i), i)), lambda i: i.isNotNull())
    hits = F.transform(found, lambda i: F.struct(
        i.cast("int").alias("position"), F.get("w", i.cast("int")).alias("word"),
        F.concat_ws(" ", F.get("w", i.cast("int") - 2), F.get("w", i.cast("int") - 1)).alias("before"),
        lead(F.get("w", i.cast("int")), i.cast("int")).alias("lead")))
    name = F.regexp_replace(F.expr("substring(match, 1, length(match) - length(value))"), "[\"'`]+$", "")
    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), words.alias("w"))
            .select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.*")
            .select("doc_id", "position", "word", "before", "lead",
                    F.posexplode(F.regexp_extract_all(F.concat("lead", "word"), F.lit(FIND), F.lit(0))).alias("part", "match"))
            .withColumn("value", F.regexp_replace("match", LEAD, ""))
            .withColumn("name", name)
            .withColumn("name", F.when((F.col("part") == 0) & F.col("name").startswith(F.col("lead")),
                                       F.expr("substring(name, length(lead) + 1)")).otherwise(F.col("name")))
            .select("doc_id", "position", "word", F.when(F.col("name") == "", F.col("before")).otherwise(F.concat_ws(" ", "before", "name")).alias("before"),
                    "part", _unwrapped().alias("candidate")))


def _unwrapped() -> Column:
    """An unquoted value without the brackets around it and the signs that end its clause; plain runs as they are."""
    value, match = F.col("value"), F.col("match")
    inner = F.regexp_replace(F.regexp_replace(value, r"[,;]+$", ""), r"^[(<\[{](.*)[)>\]}]$", "$1")
    inner = F.regexp_replace(inner, rf"^[(<\[{{]({RUN})$|^([^(<\[{{]*[^(<\[{{)>\]}},;])[)>\]}},;]+$", "$1$2")
    quoted = F.expr("substring(match, length(match) - length(value), 1)").rlike("[\"'`]")
    return F.when(match.rlike(f"^{RUN}$") | quoted | (F.length(inner) < MIN_VALUE), value).otherwise(inner)


def train(findings: DataFrame, max_findings: int = 20_000, trees: int = 24, depth: int = 6, seed: int = 5):
    """Forest over labelled findings (candidate, word, before, label 0/1); a bounded, seeded sample of each label.

    None if there are no findings, or only one label.
    """
    half = max_findings // 2
    order = F.xxhash64("candidate", "word", "before", F.lit(seed))
    clean = findings.where("candidate is not null and label is not null").select("candidate", "word", "before", "label").distinct()
    sample = clean.where("label = 1").orderBy(order, "candidate", "word", "before").limit(half).unionAll(
        clean.where("label = 0").orderBy(order, "candidate", "word", "before").limit(half))
    sample = materialize(features(sample).select(*FEATURES, F.col("label").cast("double").alias("label")), "findings")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).coalesce(1)   # at most max_findings rows
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(ready)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
                 threshold: float = 0.5, **training) -> DataFrame:
    """Every candidate with its probability and verdict.

    Returns doc_id, position, part, candidate, length, coverage, probability, is_secret.
    ``findings``: labelled candidates (candidate, word, before, label); without them,
    ``seed_findings`` labels the corpus's own candidates. Without both labels the
    probability is null and every candidate is kept as a finding. Null and empty texts
    have no candidates; rows with a null doc_id are scanned; repeated rows repeat their
    findings; an empty table gives none. Other columns are ignored.
    """
    found = materialize(candidates(docs, doc_id, text), "candidates")
    model = train(seed_findings(found) if findings is None else findings, **training)
    scored = features(found)
    if model is None:
        scored = scored.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(scored))
        scored = scored.withColumn("probability", F.get(vector_to_array("probability"), 1))
    return scored.select("doc_id", "position", "part", "candidate", F.col("length").cast("int").alias("length"), "coverage",
                         "probability", F.coalesce(F.col("probability") >= threshold, F.lit(True)).alias("is_secret"))


def seed_findings(found: DataFrame) -> DataFrame:
    """Labels for candidates whose surroundings leave no doubt; the others stay unlabelled.

    1: assigned to a key word (before it or in its own word), or a vendor's key prefix.
    0: an address, a path, or a candidate without digits or without letters that no key
    word precedes; an assigned variable, call or placeholder. Short values without digits
    stay unlabelled.
    """
    short = (F.length("candidate") < MIN_LENGTH) & ~F.col("candidate").rlike("[0-9]")
    key = F.col("before").rlike(KEY_WORDS + r"\S*(\s*([=:]|=>))?$") & (F.col("before").rlike("([=:]|=>)$") | F.col("word").rlike("^[\"'`]?[=:]"))
    prefix = F.col("candidate").rlike(PREFIXES)
    plain = (F.col("word").contains("@") | F.col("word").rlike("://|^[./~]*/") | ~F.col("candidate").rlike("[0-9]")
             | ~F.col("candidate").rlike("[A-Za-z]"))
    label = F.when(key & ~prefix & F.col("candidate").rlike(STANDS_FOR), 0).when((key & ~short) | prefix, 1).when(plain & ~F.col("before").rlike(KEY_WORDS), 0)
    return found.select("candidate", "word", "before", label.alias("label")).where(F.col("label").isNotNull())


def op3_secret_forest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs).select("doc_id", "position", "part", F.sha2("candidate", 256).alias("candidate_sha256"),
                                     "length", "coverage", "probability", "is_secret")
