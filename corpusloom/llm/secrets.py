"""Secret scans in DataFrame operations only.

Patterns propose candidates with their neighbouring words; a random forest, trained from labelled findings, removes the
false positives. Its inputs are the candidate's length, transitions between kinds of characters, dictionary coverage,
path-like signs and neighbouring words. The trained trees are turned into column expressions, so a scan is one
projection of the table, without a shuffle, and no row leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut_lineage

# Names that assign credentials, words that excuse a candidate, and common words and syllables.
KEY_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer"
EXCUSES = "example|sample|dummy|test|placeholder|changeme|commit|hash|sha1|sha256|md5|checksum|uuid|version|build|id|phone|tel|isbn|order|page|figure"
COMMON = "|".join(
    "example password secret sample placeholder changeme dummy test user name change your here this that with from have which their would about there could other after first "
    "house water place world right great small large every under again never between another because through before people number letter street school market "
    "garden window station mountain river summer winter morning evening letter paper music story travel water light night city country family friend "
    "server client config service account system module package version release build production development staging backup archive download upload "
    "document report project image photo video audio index data file page http https www com org net html json true false none null admin root home temp default public private "
    "tion ment able ness ence ance ing the and ent ver est for ist out all are not der die das und les des une que est"
    .split()
)

#: What may be a secret: a known prefix, a value after a naming word, or a long mix of letters and digits.
PREFIX = r"(?:AKIA|ASIA)[A-Z0-9]{16}"
MIXED = r"(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{12}"
NAMED = rf"(?i:{KEY_WORDS})\W{{0,2}}[=:]"
#: At a word's end, a naming word and the sign that assigns the next word to it.
ASSIGNS = rf"(?i:{KEY_WORDS})\W*[=:]"
CANDIDATE = rf"{PREFIX}|^[\"'(\[<]*{MIXED}|{NAMED}\S{{6}}"
#: Holds for every text with a candidate. A mix is only looked for at a run's first sign, so that a very long run is read once.
MAYBE = rf"{PREFIX}|(?<![A-Za-z0-9+/_=-]){MIXED}|{ASSIGNS}"
#: A known prefix's key inside a value.
KEY = rf"(?<![A-Za-z0-9]){PREFIX}(?![A-Za-z0-9])"

#: Share of trees that must vote for a secret.
LEAST = 0.5
FEATURES = ("length", "transitions", "case_changes", "digit_share", "upper_share", "lower_share", "distinct_share", "hex_only", "covered", "vowel_share", "path_signs", "signs", "prefixed", "named", "key_before", "assigned", "excused", "excused_after")


def _share(value: Column, pattern: str) -> Column:
    """The share of a value's characters left after removing all but those of a class."""
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def _features(value: Column, own: Column, before: Column, after: Column) -> list[Column]:
    number = lambda c: c.cast("double")
    lower = F.lower(value)
    return [
        number(F.length(value)),
        number(F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))),
        number(F.regexp_count(value, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))),
        number(_share(value, "[^0-9]")),
        number(_share(value, "[^A-Z]")),
        number(_share(value, "[^a-z]")),
        number(F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1))),
        number(value.rlike("^[0-9a-f]+$")),
        number(1 - F.length(F.regexp_replace(lower, COMMON, "")) / F.greatest(F.length(value), F.lit(1))),
        number(_share(lower, "[^aeiouy]")),
        number(F.regexp_count(value, F.lit(r"[/\\.]"))),
        number(F.regexp_count(value, F.lit(r"[^A-Za-z0-9]"))),
        number(value.rlike(KEY)),
        number(own.rlike(NAMED)),
        number(before.rlike(rf"(?i)(?:^|\W)(?:{KEY_WORDS})\W*(?:\s+[=:]+)?\s*$")),
        number(before.rlike(r"[=:]\s*$") | own.rlike("[=:]")),
        number(F.concat_ws(" ", before, own).rlike(rf"(?i)\b(?:{EXCUSES})\b")),
        number(after.rlike(rf"(?i)^\W*(?:{EXCUSES})\b")),
    ]


def _value(own: Column) -> Column:
    """The candidate itself: without the name it is assigned to, quotes and closing signs."""
    bare = F.regexp_replace(own, rf"^.*?{NAMED}+", "")
    bare = F.regexp_replace(bare, r"^[\"'(\[<]+", "")
    return F.regexp_replace(bare, r"[\"'].*$|(?<![^A-Za-z0-9+/=_-])[^A-Za-z0-9+/=_-]+$", "")


def labelled_findings(spark: SparkSession, each: int = 60) -> DataFrame:
    """Labelled findings made by rule: (before, own, after, label), `each` of every kind of secret and of harmless token."""
    k = F.col("k")
    hexes = lambda n: F.substring(F.sha2(F.concat(F.lit("finding"), k.cast("string")), 256), 1, n)
    mixed = lambda n: F.substring(F.translate(F.base64(F.sha2(F.concat(F.lit("mixed"), k.cast("string")), 256).cast("binary")), "=", ""), 5, n)
    upper = lambda n: F.substring(F.upper(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("upper"), k.cast("string")), 256))), "+/=", "")), 1, n)
    word = F.element_at(F.array(*[F.lit(w) for w in "station market garden window reading painter thousand mountain".split()]), (k % 8 + 1).cast("int"))
    line = F.concat(word, F.lit(" and the "))
    kinds = [
        (1, line, F.concat(F.lit("password="), hexes(18)), word),
        (1, line, F.concat(F.lit("api_key="), mixed(24)), word),
        (1, F.concat(line, F.lit("token =")), F.concat(F.lit('"'), hexes(40), F.lit('"')), word),
        (1, F.concat(line, F.lit("secret :")), F.concat(F.lit("'"), mixed(28), F.lit("'")), word),
        (1, line, F.concat(F.lit("AKIA"), upper(16)), word),
        (1, F.concat(line, F.lit("bearer")), mixed(36), word),
        (1, line, F.concat(F.lit("pwd:"), F.substring(mixed(12), 1, 10)), word),
        (0, F.concat(line, F.lit("commit")), hexes(40), word),
        (0, F.concat(line, F.lit("sha256 hash")), hexes(64), word),
        (0, line, F.concat(F.lit("password="), F.element_at(F.array(*[F.lit(w) for w in "yourpassword changeme example placeholder xxxxxxxx ******** <password> required".split()]), (k % 8 + 1).cast("int"))), word),
        (0, line, F.concat(word, F.lit("-"), word, F.lit("-2019-release-"), k.cast("string")), word),
        (0, F.concat(line, F.lit("see")), F.concat(F.lit("/home/data/"), word, F.lit("/"), word, F.lit("_2021_"), word), word),
        (0, F.concat(line, F.lit("phone")), F.concat(F.lit("0"), F.substring(F.translate(hexes(40), "abcdef", ""), 1, 14)), word),
        (0, F.concat(line, F.lit("order id")), F.concat(F.lit("1"), F.substring(F.translate(hexes(60), "abcdef", ""), 1, 16)), word),
        (0, line, F.concat(word, word, F.lit("2"), word, word), word),
        (0, F.concat(line, F.lit("uuid")), F.concat_ws("-", hexes(8), F.substring(hexes(40), 9, 4), F.substring(hexes(40), 13, 4), F.substring(hexes(40), 17, 4), F.substring(hexes(40), 21, 12)), word),
        (0, F.concat(line, F.lit("=")), F.concat(F.lit("1234567890123"), k.cast("string")), word),
        (0, line, F.concat(F.lit("token:"), word, F.lit("-"), word), word),
    ]
    out = None
    for label, before, own, after in kinds:
        part = spark.range(0, each, 1, 1).select(F.col("id").alias("k")).select(before.alias("before"), own.alias("own"), after.alias("after"), F.lit(float(label)).alias("label"))
        out = part if out is None else out.union(part)
    return out.coalesce(1)  # type: ignore[union-attr]  # a thousand rows


def train(findings: DataFrame, trees: int = 15, depth: int = 5) -> RandomForestClassificationModel:
    """A random forest on labelled findings (before, own, after, label 0.0 or 1.0): a curated, bounded table."""
    values = _features(_value(F.col("own")), F.col("own"), F.col("before"), F.col("after"))
    table = findings.na.fill("", ["before", "own", "after"]).select("label", *[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird").fit(ready)


Forest = Callable[[Callable[[int], Column]], Column]


def compile_forest(model: RandomForestClassificationModel) -> Forest:
    """The share of trees that vote for a secret, as a function of what gives the column of a feature by its number."""

    def tree(lines: list[tuple[int, str]], at: int) -> tuple[Forest, int]:
        depth, text = lines[at]
        if text.startswith("Predict"):
            vote = float(text.split(":")[1])
            return (lambda _: F.lit(vote)), at + 1
        number, threshold = re.match(r"If \(feature (\d+) <= (.+)\)", text).groups()  # type: ignore[union-attr]
        left, at = tree(lines, at + 1)
        right, at = tree(lines, at)
        return (lambda f: F.when(f(int(number)) <= float(threshold), left(f)).otherwise(right(f))), at

    votes = []
    for t in model.trees:
        lines = [(len(x) - len(x.lstrip()), x.strip()) for x in t.toDebugString.splitlines()[1:] if x.strip()]
        lines = [x for x in lines if not x[1].startswith("Else")]
        votes.append(tree(lines, 0)[0])

    def share(f: Callable[[int], Column]) -> Column:
        total = F.lit(0.0)
        for v in votes:
            total = total + v(f)
        return total / len(votes)

    return share


def _candidates(words: Column) -> Column:
    """Candidates among a text's words: array of (word, own, before, after)."""

    def candidate(own: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.get(words, i + k), F.lit(""))
        found = F.struct(i.alias("word"), own.alias("own"), F.concat_ws(" ", near(-3), near(-2), near(-1)).alias("before"), near(1).alias("after"))
        assigned = own.rlike(r"^[\"']?\S{6,}[\"']?$") & F.concat_ws(" ", near(-2), near(-1)).rlike(rf"{ASSIGNS}$")
        return F.when(own.rlike(CANDIDATE) | assigned, found)

    return F.filter(F.transform(words, candidate), lambda c: c.isNotNull())


def _kind(value: Column, own: Column, before: Column) -> Column:
    named = own.rlike(NAMED) | before.rlike(rf"(?i)(?:{KEY_WORDS})\W*$")
    return F.when(value.rlike(KEY), "access_key").when(named, "assignment").otherwise("token")


def _scored(suspect: DataFrame, key: str, forest: Forest) -> DataFrame:
    """The secrets of (key, text) rows: key, word, kind, value and score, a row each."""
    rows = suspect.select(key, F.split("text", r"\s+").alias("words")).select(key, F.explode(_candidates(F.col("words"))).alias("c"))
    rows = rows.select(key, "c.*", _value(F.col("c.own")).alias("value")).where(F.length("value") >= 6)
    columns = _features(*(F.col(c) for c in ("value", "own", "before", "after")))
    rows = rows.select(key, "word", _kind(*(F.col(c) for c in ("value", "own", "before"))).alias("kind"), "value", *[f.alias(n) for f, n in zip(columns, FEATURES, strict=True)])
    # as an array function, since the trees are too long a code for one compiled method
    votes = F.get(F.transform(F.array(F.array(*[F.col(f) for f in FEATURES])), lambda f: forest(lambda i: F.get(f, F.lit(i)))), F.lit(0))
    return rows.select(key, "word", "kind", "value", votes.alias("score")).where(F.col("score") >= LEAST)


def scan_secrets(documents: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row a secret: doc_id, word (its place, from 0), kind, value, value_sha256, n_chars and score.

    Takes (doc_id, text), ignores other columns. findings: labelled ones to train on, by default those made by rule. A
    null or empty text has no secrets, a null doc_id stays null, repeated rows are reported each, ties of the
    votes count as secrets, a text of any length is read whole, and an empty table gives an empty result.
    """
    forest = compile_forest(train(labelled_findings(documents.sparkSession) if findings is None else findings))
    suspect = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(MAYBE))
    found = _scored(suspect, "doc_id", forest)
    return found.select("doc_id", "word", "kind", "value", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("n_chars"), "score")


def redact_secrets(documents: DataFrame, mark: str = "[SECRET]", findings: DataFrame | None = None) -> DataFrame:
    """documents, with each found secret's value replaced in text wherever it stands there, the longest values first.

    All rows and columns stay, in no order; texts without secrets, null and empty ones stay as they are, repeated rows
    are redacted each, whatever their doc_id, and an empty table gives an empty result. Secrets are found as by
    scan_secrets. Rows that may have one are written once with a key, and what is found comes back to them by that key.
    """
    forest = compile_forest(train(labelled_findings(documents.sparkSession) if findings is None else findings))
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    aside = {c: f"column {i}" for i, c in enumerate(documents.columns)}
    plain = documents.select(*[F.col(f"`{c}`").alias(k) for c, k in aside.items()], F.col("text").cast("string").alias("text"))
    suspect = cut_lineage(plain.where(maybe).withColumn("row", F.monotonically_increasing_id()))
    values = _scored(suspect.select("row", "text"), "row", forest).groupBy("row").agg(F.collect_set("value").alias("found"))
    ordered = F.array_sort(F.transform("found", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    redacted = F.aggregate(F.coalesce(ordered, F.array().cast("array<struct<n:int,v:string>>")), F.col("text"), lambda t, v: F.replace(t, v["v"], F.lit(mark)))
    names = [(redacted if c.lower() == "text" else F.col(f"`{k}`")).alias(c) for c, k in aside.items()]
    same = [(F.col("text") if c.lower() == "text" else F.col(f"`{k}`")).alias(c) for c, k in aside.items()]
    return suspect.join(values, "row", "left").select(*names).union(plain.where(~maybe).select(*same))
