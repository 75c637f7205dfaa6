"""Dependency graphs: (doc_id, sent_id, tok_id, head, upos, deprel, start, end) with head 0 for a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import distances, reached

KEY = ["doc_id", "sent_id"]
UNREACHABLE = 99
#: Relations that a nominal span keeps, and parts of speech trimmed from its ends.
KEPT = ("flat", "flat:name", "amod", "det", "case", "compound", "nummod", "fixed")
#: Further relations that it keeps below such parts of speech.
KEPT_OF = {"nmod": ("NOUN", "PROPN", "NUM", "ADJ"), "appos": ("PROPN",)}
LEFT_TRIM, RIGHT_TRIM = ("DET", "ADP", "PUNCT"), ("PUNCT", "ADP")


def hops(tokens: DataFrame, source: Column, most: int = 5) -> DataFrame:
    """(key, source, tok_id, hops): tokens within `most` undirected steps of each token that `source` holds for."""
    return distances(tokens, source, most, None)


def all_hops(tokens: DataFrame, source: Column, most: int = 5) -> DataFrame:
    """The same for every token of a source's sentence, UNREACHABLE for those that are further away or not linked."""
    return distances(tokens, source, most, UNREACHABLE)


def span_heads(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """The head token of each (key, first, last) span: the first whose governor is the root or outside."""
    t = tokens.select(*KEY, "tok_id", "head")
    inside = spans.join(t, KEY).where(F.col("tok_id").between(F.col("first"), F.col("last")))
    heads = inside.where((F.col("head") == 0) | ~F.col("head").between(F.col("first"), F.col("last")))
    return heads.groupBy(*KEY, "first", "last").agg(F.min("tok_id").alias("head_tok"))


def trim_bounds(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans without determiners, adpositions and punctuation at their left end, or punctuation and adpositions at their right."""
    t = tokens.select(*KEY, "tok_id", "upos")
    inside = spans.join(t, KEY).where(F.col("tok_id").between(F.col("first"), F.col("last")))
    left = F.min(F.when(~F.col("upos").isin(*LEFT_TRIM), F.col("tok_id")))
    right = F.max(F.when(~F.col("upos").isin(*RIGHT_TRIM), F.col("tok_id")))
    return inside.groupBy(*KEY, "first", "last").agg(left.alias("trim_first"), right.alias("trim_last")).where("trim_first <= trim_last")


def kept_below(kept: tuple[str, ...] = KEPT) -> Column:
    """Whether a nominal span keeps a token: by its relation (or a subtype of it), and for some relations by its part of speech."""
    base = F.substring_index(F.lower("deprel"), ":", 1)
    follow = base.isin(*{k.split(":")[0] for k in kept}, "name")
    for relation, parts in KEPT_OF.items():
        follow = follow | ((base == relation) & F.col("upos").isin(*parts))
    return follow


def closure(tokens: DataFrame, root: Column, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """(key, root, first, last, size): the nominal subtree of each token that `root` holds for, through kept relations only.

    Chains of any length are followed, and cycles end.
    """
    return reached(tokens, kept_below(kept), root)


def _sentences(tokens: DataFrame, *columns: str) -> DataFrame:
    """Each sentence's tokens (ids 1 to n) as one array by id, so that walks along heads look up places instead of joining."""
    return tokens.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tok_id", "head", *columns))).alias("t"))


def _at(place: Column) -> Column:
    """The token at a place of `t`, or null for 0 and beyond."""
    return F.when(place > 0, F.get("t", (place - 1).cast("int")))


def governing_verb(tokens: DataFrame, most: int = 4) -> DataFrame:
    """The nearest verb above each token, at most so many steps up: one walk along heads in the sentence's array."""

    def walk(x: Column) -> Column:
        start = F.struct(x["head"].alias("at"), F.lit(None).cast("long").alias("verb"))

        def step(a: Column, _: Column) -> Column:
            here = _at(a["at"])
            verb = F.coalesce(a["verb"], F.when(here["upos"] == "VERB", here["tok_id"]))
            return F.struct(F.coalesce(here["head"], F.lit(0)).alias("at"), verb.alias("verb"))

        return F.struct(x["tok_id"].alias("tok_id"), F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["verb"].alias("verb"))

    return _sentences(tokens, "upos").select(*KEY, F.explode(F.transform("t", walk)).alias("r")).select(*KEY, "r.*")


def propagate_roles(tokens: DataFrame, role: str, passes: int = 4) -> DataFrame:
    """(…, tok_id, role): conjuncts without a role take that of the nearest token above them that has one, over conjuncts only, at most so many steps up."""

    def walk(x: Column) -> Column:
        start = F.struct(x["head"].alias("at"), (x["deprel"] == "conj").alias("on"), x[role].alias("role"))

        def step(a: Column, _: Column) -> Column:
            here = _at(a["at"])
            on = a["on"] & a["role"].isNull()
            found = F.coalesce(a["role"], F.when(on, here[role]))
            return F.struct(F.coalesce(here["head"], F.lit(0)).alias("at"), (on & F.coalesce(here["deprel"] == "conj", F.lit(False))).alias("on"), found.alias("role"))

        return F.struct(x["tok_id"].alias("tok_id"), F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step)["role"].alias(role))

    return _sentences(tokens, "deprel", role).select(*KEY, F.explode(F.transform("t", walk)).alias("r")).select(*KEY, "r.*")


def role_of(deprel: Column) -> Column:
    """Syntactic relation to role; null where none."""
    return (
        F.when(deprel.isin("nsubj", "nsubj:pass", "csubj"), "SUBJECT").when(deprel.isin("obj", "ccomp"), "OBJECT").when(deprel == "iobj", "IOBJ")
        .when(deprel.isin("obl", "obl:arg"), "OBLIQUE").when(deprel == "appos", "APPOS").when(deprel == "nmod", "NMOD")
    )


def verb_groups(tokens: DataFrame) -> DataFrame:
    """Verbs with their auxiliaries: bounds, whether passive, whether negated."""
    kids = tokens.where(F.col("deprel").isin("aux", "aux:pass", "advmod")).select(*KEY, F.col("head").alias("verb"), F.col("tok_id").alias("kid"), "deprel", F.lower("word").alias("w"))
    verbs = tokens.where("upos = 'VERB'").select(*KEY, F.col("tok_id").alias("verb"))
    joined = verbs.join(kids, [*KEY, "verb"], "left")
    aux = F.when(F.col("deprel").startswith("aux"), F.col("kid"))
    return joined.groupBy(*KEY, "verb").agg(
        F.least(F.min(aux), F.first("verb")).alias("first"), F.greatest(F.max(aux), F.first("verb")).alias("last"),
        F.coalesce(F.bool_or(F.col("deprel") == "aux:pass"), F.lit(False)).alias("passive"), F.coalesce(F.bool_or(F.col("w").isin("not", "ne", "pas")), F.lit(False)).alias("negated"),
    )


def first_edge(edges: DataFrame) -> DataFrame:
    """One edge a child: that of the rule with the least number, then the most confident."""
    order = Window.partitionBy(*KEY, "child").orderBy("rule", F.desc("confidence"), "parent")
    return edges.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def merge_edges(rules: DataFrame, parser: DataFrame) -> DataFrame:
    """Edges of rules and of a parser by child: agreement adds 0.05 to the confidence, conflict costs 15 percent of it."""
    a = rules.select(*KEY, "child", F.col("parent").alias("a_parent"), F.col("confidence").alias("a_conf"))
    b = parser.select(*KEY, "child", F.col("parent").alias("b_parent"), F.col("confidence").alias("b_conf"))
    both = a.join(b, [*KEY, "child"], "full")
    agreed = F.col("a_parent") == F.col("b_parent")
    conf = F.when(F.col("b_parent").isNull(), F.col("a_conf")).when(F.col("a_parent").isNull(), F.col("b_conf")).when(agreed, F.least(F.lit(1.0), F.greatest("a_conf", "b_conf") + 0.05)).otherwise(F.col("a_conf") * 0.85)
    source = F.when(F.col("b_parent").isNull(), "rule").when(F.col("a_parent").isNull(), "parser").when(agreed, "both").otherwise("conflict")
    return both.select(*KEY, "child", F.coalesce("a_parent", "b_parent").alias("parent"), conf.alias("confidence"), source.alias("source"))
