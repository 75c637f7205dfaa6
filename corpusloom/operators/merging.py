"""Entities and parses merged: spans trimmed to words that can bound one, split into role and name, and grown along the tree.

Tokens: (doc_id, sent_id, tok_id, head, upos, deprel, word, start, end). Entities: (doc_id, sent_id, start, end, type). A
sentence's tokens, entities and spans lie beside each other, and are worked out together by whole columns of a batch of
sentences; so nothing is shuffled but what comes from several tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .beside import codes, firsts, kinds, numbers, spread_out, together, worked
from .walks import KEY, NONE, gathered, spread

# Parts of speech that don't bound or head an entity, and relations of names, nominal phrases and codes.
SKIP_LEFT, SKIP_RIGHT = ("PUNCT", "DET", "ADP"), ("PUNCT", "ADP")
FUNCTION = ("ADP", "DET", "CCONJ", "SCONJ", "PART", "INTJ", "PUNCT", "AUX")
NAME = ("flat", "flat:name", "name", "nmod", "appos")
NOMINAL = ("amod", "compound", "flat", "name", "nummod")
CHAIN_PARTS = ("NOUN", "PROPN", "NUM", "ADJ")
PROPER = ("flat", "name", "appos", "nmod")
DE_PARTS = ("flat", "name", "compound", "amod", "nummod", "appos")
CODE = ("flat", "name", "nummod", "appos", "compound")
#: What a candidate comes from, best first.
SOURCES = ("unchanged", "trimmed", "role", "name", "reconstructed", "noun_propn", "noun_de_chain", "noun_code")
#: Beyond any place.
FAR = 1 << 60


def base(deprel: Column) -> Column:
    return F.substring_index(F.lower(deprel), ":", 1)


def aligned(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with first and last, the ids of the tokens that they overlap, null where there are none.

    Both sides of a sentence are gathered, and all its spans look up their bounds among the tokens' at once; tokens don't
    overlap one another. Spans of a sentence without tokens have nulls.
    """
    rows = gathered(tokens, start=F.col("start").cast("long"), end=F.col("end").cast("long"))
    others = [c for c in spans.columns if c not in KEY]
    listed = spans.groupBy(*KEY).agg(F.collect_list(F.struct(*others)).alias("spans"))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, s = batch.column("t"), batch.column("spans")
            items, asked = t.flatten(), s.flatten()
            of = np.repeat(np.arange(batch.num_rows), np.asarray(s.value_lengths().fill_null(0)))
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(t.value_lengths().fill_null(0)))
            ids, low, high = (np.asarray(items.field(n)) for n in ("tok_id", "start", "end"))
            begin, end = (np.asarray(asked.field(n)).astype(np.int64) for n in ("start", "end"))
            width = int(max([0, *high, *end])) + 1
            # the first token that ends behind a span's start, and the last that starts before its end
            first = np.searchsorted(owner * width + high, of * width + begin, "right")
            last = np.searchsorted(owner * width + low, of * width + end, "left") - 1
            there = (first <= last) & (begin < end)
            pick = lambda at: pa.array(ids[np.clip(at, 0, max(0, len(ids) - 1))] if len(ids) else np.zeros(len(at), np.int64), mask=~there)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in KEY), *(asked.field(c) for c in others), pick(first), pick(last)], [*KEY, *others, "first", "last"])

    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*KEY, *others]), "first bigint", "last bigint"])
    return listed.join(rows, KEY, "left").withColumn("t", F.coalesce("t", F.array().cast(rows.schema["t"].dataType))).mapInArrow(run, shape)


#: Marks of tokens: by their relation, by their part of speech, and by both.
MARKS = ("case", "small", "part", "nominal", "chain", "proper", "code", "nmod", "noun", "propn", "not_left", "not_right", "no_head", "pron", "named", "adp_case", "code_kind")


def _mark(upos: str | None, deprel: str | None) -> int:
    """A token's marks as bits of one number, in the order of MARKS; those of a code are left to what is said of its word."""
    kind = (deprel or "").lower()
    rel, propn = kind.split(":")[0], upos == "PROPN"
    said = (
        rel == "case", rel in ("case", "det"), rel in DE_PARTS, rel in NOMINAL or (rel == "appos" and propn), rel == "nmod" and upos in CHAIN_PARTS, propn and rel in PROPER, rel in CODE, rel == "nmod", upos == "NOUN", propn,
        upos is None or upos in SKIP_LEFT, upos is None or upos in SKIP_RIGHT, upos in (*FUNCTION, "VERB", "ADV"), upos == "PRON", propn and kind in NAME, upos == "ADP" and kind == "case", upos in ("PROPN", "NUM"),
    )
    return sum(1 << i for i, x in enumerate(said) if x)


def _marks(upos: pa.Array, deprel: pa.Array) -> np.ndarray:
    """Marks of all tokens: worked out once for each pair that there is."""
    u, d = upos.dictionary_encode(), deprel.dictionary_encode()
    pairs, at = np.unique((numbers(u.indices, -1) + 1) * (len(d.dictionary) + 1) + numbers(d.indices, -1) + 1, return_inverse=True)
    uposes, deprels = [None, *u.dictionary.to_pylist()], [None, *d.dictionary.to_pylist()]
    return np.array([_mark(uposes[p // len(deprels)], deprels[p % len(deprels)]) for p in pairs.tolist()], np.int64)[at]


class Tokens:
    """The tokens of some sentences, in the order of their ids; up is the place of a token's head, or NONE."""

    def __init__(self, sentence: np.ndarray, ids: np.ndarray, head: np.ndarray, low: np.ndarray, high: np.ndarray, marks: np.ndarray, sign: np.ndarray) -> None:
        order = np.lexsort((ids, sentence))
        self.sentence, self.id, self.head, self.low, self.high, self.marks, self.sign = (x[order] for x in (sentence, ids, head, low, high, marks, sign))
        least = min([0, *self.id[:1], int(self.id.min(initial=0)), int(self.head.min(initial=0))])
        width = int(max(self.id.max(initial=0), self.head.max(initial=0))) - least + 1
        own, wanted = self.sentence * width + self.id - least, self.sentence * width + self.head - least
        at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
        self.up = np.where(own[at] == wanted, at, NONE) if len(own) else at

    def has(self, name: str) -> np.ndarray:
        return (self.marks >> MARKS.index(name)) & 1 == 1

    def below(self, values: np.ndarray, when: np.ndarray, least: bool) -> np.ndarray:
        """The least (FAR if there is none) or greatest (-FAR) value of those right below each token for which `when` holds."""
        out = np.full(len(self.id), FAR if least else -FAR)
        at = np.flatnonzero(when & (self.up != NONE))
        (np.minimum if least else np.maximum).at(out, self.up[at], values[at])
        return out

    def over(self, sentence: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last token that each span of a sentence overlaps, the last before the first where there is none; tokens don't overlap one another."""
        width = int(max(self.high.max(initial=0), end.max(initial=0))) + 1
        first = np.searchsorted(self.sentence * width + self.high, sentence * width + np.maximum(start, 0), "right")
        last = np.searchsorted(self.sentence * width + self.low, sentence * width + np.maximum(end, 0), "left") - 1
        return first, np.where(start < end, last, first - 1)

    def grown(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """The bounds of the phrases that tokens head, the low one FAR where there is none.

        reconstructed: the token and what hangs below it as adjective, part of a name or number, proper apposition, or
        nominal with a case word, of any depth; those below it come with their case words and determiners. noun_propn: with
        its proper nouns, and theirs. noun_de_chain: with nominals that have a case word or determiner, these, and the
        parts of their names. noun_code: with proper nouns, numbers and signs in capitals right below it.
        """
        small, parts = self.has("small"), self.has("part") | self.has("small")
        has_case = self.below(self.low, self.has("case"), True) < FAR
        small_low, parts_low = self.below(self.low, small, True), self.below(self.low, parts, True)
        low, high = np.minimum(self.low, small_low), np.maximum(self.high, self.below(self.high, small, False))
        nominal, proper, code = self.has("nominal") | (self.has("chain") & has_case), self.has("proper"), self.has("code") & (self.has("code_kind") | self.sign)
        walk = np.where((self.head == self.id) | (self.head == 0), NONE, self.up)
        n_low, n_high = spread(walk, nominal, low, high)
        p_low, p_high = spread(walk, proper, self.low, self.high)
        de = self.has("nmod") & (small_low < FAR)
        kept = {
            "reconstructed": (self.below(n_low, nominal, True), self.below(n_high, nominal, False)), "noun_propn": (self.below(p_low, proper, True), self.below(p_high, proper, False)),
            "noun_de_chain": (self.below(np.minimum(self.low, parts_low), de, True), self.below(np.maximum(self.high, self.below(self.high, parts, False)), de, False)), "noun_code": (self.below(self.low, code, True), self.below(self.high, code, False)),
        }
        out = {}
        for name, (a, b) in kept.items():
            there = np.ones(len(a), bool) if name == "reconstructed" else self.has("noun") & (a < FAR)
            out[name] = np.where(there, np.minimum(self.low, a), FAR), np.maximum(self.high, b)
        return out


def _first(of: np.ndarray, at: np.ndarray, when: np.ndarray, n: int) -> np.ndarray:
    """For each of n ranges the first of its places for which `when` holds, or FAR."""
    out = np.full(n, FAR)
    np.minimum.at(out, of[when], at[when])
    return out


def _last(of: np.ndarray, at: np.ndarray, when: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NONE)
    np.maximum.at(out, of[when], at[when])
    return out


def _merged(t: Tokens, sentence: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, person: np.ndarray) -> tuple[np.ndarray, ...]:
    """Candidates as (entity, source, start, end, head), as merge_entities says; source is a place in SOURCES, and a head of NONE none."""
    own = firsts(sentence, start, end, kind, by=4)
    s, b, e = sentence[own], start[own], end[own]
    first, last = t.over(s, b, e)
    alone = last < first
    n = len(own)
    of, at = spread_out(first, last)
    a, z = _first(of, at, ~t.has("not_left")[at], n), _last(of, at, ~t.has("not_right")[at], n)
    on = np.flatnonzero(~alone & (a < FAR))
    a, z, who = a[on], z[on], person[own][on]
    of, at = spread_out(a, z)
    up = t.up[at]
    inside = (up >= a[of]) & (up <= z[of])
    h = _first(of, at, (t.head[at] == 0) | ~inside, len(on))
    h = np.where(h < FAR, h, a)
    good = ~t.has("no_head")[h] & (~t.has("pron")[h] | who)
    named = t.has("named")[at] & inside
    begin = np.cumsum(z - a + 1) - (z - a + 1)
    of_named = np.zeros(len(at), bool)
    of_named[inside] = named[(begin[of] + up - a[of])[inside]]
    part = named | (t.has("adp_case")[at] & of_named)
    f = len(on)
    role_first, role_last = _first(of, at, ~part, f), _last(of, at, ~part & ~t.has("not_right")[at], f)
    name_first, name_last, name_head = _first(of, at, part, f), _last(of, at, part, f), _first(of, at, part & t.has("propn")[at], f)
    split = good & who & t.has("noun")[h] & (name_first < FAR) & (role_last != NONE)
    found = [(np.flatnonzero(alone), "unchanged", b[alone], e[alone], np.full(alone.sum(), NONE))]

    def add(source: str, there: np.ndarray, low: np.ndarray, high: np.ndarray, head: np.ndarray) -> None:
        found.append((on[there], source, low[there], high[there], head[there]))

    at_most = lambda x: np.minimum(x, max(0, len(t.id) - 1))  # noqa: E731  what isn't there isn't taken
    if len(t.id):
        add("trimmed", good, t.low[a], t.high[z], t.id[h])
        add("role", split, t.low[at_most(role_first)], t.high[role_last], t.id[h])
        add("name", split, t.low[at_most(name_first)], t.high[name_last], t.id[at_most(np.where(name_head < FAR, name_head, name_first))])
        for source, (low, high) in t.grown().items():
            add(source, good & (low[h] < FAR), low[h], high[h], t.id[h])
    who, low, high, head = (np.concatenate([x[i] for x in found]) for i in (0, 2, 3, 4))
    source = np.concatenate([np.full(len(x[0]), SOURCES.index(x[1])) for x in found])
    best = firsts(s[who], kind[own][who], low, high, source, head, by=4)
    return own[who[best]], source[best], low[best], high[best], head[best]


def _headed(t: Tokens, sentence: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, head): the first proper noun of each span, else noun, else word; equal spans once, and none without a word."""
    own = firsts(sentence, start, end, kind, by=4)
    first, last = t.over(sentence[own], start[own], end[own])
    of, at = spread_out(first, last)
    rank = np.where(t.has("propn")[at], 0, np.where(t.has("noun")[at], 1, 2))
    n = len(t.id) + 1
    best = _first(of, rank * n + at, np.ones(len(at), bool), len(own))
    there = best < FAR
    return own[there], t.id[best[there] % n]


def _uncovered(s: np.ndarray, start: np.ndarray, end: np.ndarray, by_s: np.ndarray, by_start: np.ndarray, by_end: np.ndarray) -> np.ndarray:
    """Which spans none of the others of their sentence overlaps: by what started before and reaches furthest, and what starts next."""
    low = min(0, int(start.min(initial=0)), int(by_start.min(initial=0)), int(by_end.min(initial=0)))
    width = int(max(end.max(initial=0), by_end.max(initial=0), by_start.max(initial=0), start.max(initial=0))) - low + 1
    order = np.lexsort((by_start, by_s))
    starts = np.append((by_s * width + by_start - low)[order], FAR)
    reach = np.concatenate([[-FAR], np.maximum.accumulate((by_s * width + by_end - low)[order])])
    at = s * width + start - low
    return (reach[np.searchsorted(starts, at, "right")] <= at) & (starts[np.searchsorted(starts, at, "left")] >= s * width + end - low)


def laid_candidates(rows: DataFrame) -> DataFrame:
    """(key, start, end, name, source, head): candidates of tokens, entities and the parse's own spans of a sentence that lie beside each other.

    rows: side (word, entity or simple), start and end; words have tok_id, head, upos, deprel and sign (whether they are
    signs in capitals), the others name, which is an entity's type or a simple span's label, and which the candidates get
    from theirs. All of a sentence's answers come
    from one pass over its rows, so that nothing is shuffled.
    """

    def work(batch: pa.RecordBatch, sentence: np.ndarray) -> pa.RecordBatch:
        side, name = batch.column("side"), batch.column("name")
        start, end, head, ids = (numbers(batch.column(c)) for c in ("start", "end", "head", "tok_id"))
        words, entities, simple = (np.flatnonzero(np.asarray(pc.equal(side, x))) for x in ("word", "entity", "simple"))
        mark, sign = _marks(batch.column("upos"), batch.column("deprel")), np.asarray(pc.fill_null(batch.column("sign"), False))
        t = Tokens(*(x[words] for x in (sentence, ids, head, start, end, mark, sign)))
        kind, person = codes(name), np.asarray(pc.fill_null(pc.equal(pc.utf8_lower(name), "per"), False))
        of, source, low, high, top = _merged(t, *(x[entities] for x in (sentence, start, end, kind, person)))
        at = entities[of]
        own, own_head = _headed(t, *(x[simple] for x in (sentence, start, end, kind)))
        rest = simple[own]
        free = _uncovered(sentence[rest], start[rest], end[rest], sentence[at], low, high)
        rest, own_head = rest[free], own_head[free]
        every = pa.array(np.concatenate([at, rest]))
        heads = np.concatenate([top, own_head])
        sources = pa.array([*SOURCES, "parse"]).take(pa.array(np.concatenate([source, np.full(len(rest), len(SOURCES))])))
        columns = [np.concatenate([low, start[rest]]), np.concatenate([high, end[rest]])]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(every) for k in KEY), *map(pa.array, columns), name.take(every), sources, pa.array(heads, mask=heads == NONE)], [*KEY, "start", "end", "name", "source", "head"])

    return worked(rows, work, f"{kinds(rows, *KEY)}, start bigint, end bigint, name string, source string, head bigint")


def in_signs(word: Column) -> Column:
    """Whether a word is a sign in capitals and digits."""
    return word.rlike("^[A-Z0-9-]+$")


def _words(tokens: DataFrame) -> DataFrame:
    return tokens.select(*KEY, F.col("tok_id").cast("long").alias("tok_id"), F.col("head").cast("long").alias("head"), "upos", "deprel", in_signs(F.col("word")).alias("sign"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _named(spans: DataFrame, name: str) -> DataFrame:
    return spans.select(*KEY, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(name).alias("name"))


def _typed(found: DataFrame) -> DataFrame:
    kind = F.when(F.col("source") == "parse", coarse_of(F.col("name"))).otherwise(F.col("name"))
    return found.select(*KEY, "start", "end", kind.alias("type"), "source", "head")


def merge_entities(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """(key, start, end, type, source, head): candidates for entities, by their own words and along the tree, once each, in no order.

    A span is trimmed of determiners, adpositions and signs at its left end, signs and adpositions at its right; without
    any word left it goes. Its head is the first word whose governor isn't among them (the first word, if there is none);
    spans headed by a function word, verb or adverb go, and pronouns unless a person. Candidates: the trimmed span; role
    and name of a person headed by a noun; the phrases that grown() finds around the head. A name is every proper noun
    that hangs, as part of a name, nominal or apposition, from a token of the span, with the case words of these; the role
    is the rest, without case words and signs at its end. A span that overlaps no token stays as it is, without a head.
    Types are compared in lower case; of equal places of a type the first source stands.
    """
    return _typed(laid_candidates(together(word=_words(tokens), entity=_named(entities, "type"))))


def merged_laid(rows: DataFrame) -> DataFrame:
    """merge_entities of rows beside each other (see laid_candidates)."""
    return _typed(laid_candidates(rows))


def coarse_of(label: Column) -> Column:
    """A fine label's coarse type."""
    has = lambda *xs: F.lit(False) if not xs else label.contains(xs[0]) | has(*xs[1:])
    return F.when(has("PERSON", "GROUP", "NORP"), "PER").when(has("GPE", "LOC", "FAC", "INFRA"), "LOC").when(has("ORG"), "ORG").when(has("TIME"), "TIME").when(has("EVENT"), "EVENT").otherwise("OBJECT")


def from_parse(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, start, end, type, head): spans (start, end, label) of a parse alone, headed by their first proper noun, else noun, else word; those without a word go."""
    return merged_laid(together(word=_words(tokens.withColumns({c: F.lit(None).cast(k) for c, k in (("head", "long"), ("deprel", "string"), ("word", "string")) if c not in tokens.columns})), simple=_named(spans, "label"))).drop("source")


def not_covered(rows: DataFrame, cover: DataFrame) -> DataFrame:
    """rows whose place no row of cover overlaps.

    Places of a sentence meet in one sorted pass: a row is covered from before if what started earlier reaches beyond its
    start, and from behind if the next start lies before its end.
    """
    both = rows.select(*KEY, "start", "end", F.lit(1).alias("side")).distinct().unionByName(cover.select(*KEY, "start", "end", F.lit(0).alias("side")).distinct())
    w = Window.partitionBy(*KEY)
    earlier = F.max(F.when(F.col("side") == 0, F.col("end"))).over(w.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.min(F.when(F.col("side") == 0, F.col("start"))).over(w.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    reach = both.withColumns({"reach": earlier, "next": later}).where("side = 1")
    free = reach.where((F.col("reach").isNull() | (F.col("reach") <= F.col("start"))) & (F.col("next").isNull() | (F.col("next") >= F.col("end"))))
    return rows.join(free.select(*KEY, "start", "end"), [*KEY, "start", "end"], "left_semi")


def candidates(tokens: DataFrame, entities: DataFrame, simple: DataFrame) -> DataFrame:
    """(key, start, end, type, source, head): the merged entities, and of the parse's own spans those that overlap none of them (source parse).

    Both branches work on the same rows, so the sentences are read and parsed once.
    """
    return merged_laid(together(word=_words(tokens), entity=_named(entities, "type"), simple=_named(simple, "label")))
