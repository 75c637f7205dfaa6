"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into blocks of a bounded size, so no task grows with the corpus. Each block is evolved on
several islands. A solution is a set of bins; crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold duplicates of their pieces, and best-fits the pieces this displaces. Between epochs each
island's elite migrates to the next island of its block. The poorly filled bins that remain, about one a block, are
emptied and their pieces packed in the same way once more.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import RELEASE, cut_lineage, trimmed
from .words import slices

#: Pieces of a block, islands of a block, epochs, solutions of an island, and generations of an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 4, 3, 6, 12
#: Bytes each half of a worker's cache of words holds, about. When the new half is full it becomes the old one, whose words come back when they are met.
CACHE = 100_000_000
#: Words that are encoded as one text.
TOGETHER = 200
#: Signs that the tokenizer parts from letters and numbers beside them, and letters and digits of one byte.
SIGNS = string.punctuation.encode()
PLAIN = frozenset((string.ascii_letters + string.digits).encode())
#: Marks that join some small letters, but not the capitals, to one character: such texts are not lower-cased beforehand.
JOINING = "\u0308\u030a\u030c\u0331\u0344"
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        special = [t.content for t in found.get_added_tokens_decoder().values()]
        vocabulary = found.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _TOKENIZERS[path] = (found, [{}, {}], {}, special, [0], ends)
        RELEASE.append(_TOKENIZERS.clear)
    return _TOKENIZERS[path]


def _parted(tokenizer, letter: str, known: dict[str, bool]) -> bool:
    """Whether the tokenizer, by its own rules, parts a character from signs on both sides."""
    if letter not in known:
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(f".{letter}."))
        known[letter] = len(pieces) > 2 and pieces[0][0] == pieces[-1][0] == "."
    return known[letter]


def _cut(tokenizer, word: bytes, known: dict[str, bool]) -> tuple[bytes, ...]:
    """The word's opening signs, body and closing signs, as far as the tokenizer parts them; the word whole otherwise.

    A run of signs is one piece for the tokenizer, and marks and emoji are signs to it. So only what stands beside a
    letter or number is cut off, and not an opening apostrophe, which may be part of a contraction.
    """
    body = word.strip(SIGNS)
    if not body or len(body) == len(word):
        return (word,)
    start = word.index(body)
    end = start + len(body)
    first, last = body[0] in PLAIN, body[-1] in PLAIN
    if not (first and last):
        text = body.decode()
        first, last = first or _parted(tokenizer, text[0], known), last or _parted(tokenizer, text[-1], known)
    if not first or word[:start] == b"'":
        start = 0
    if not last:
        end = len(word)
    return tuple(x for x in (word[:start], word[start:end], word[end:]) if x)


def _encode_parts(tokenizer, parts: list[bytes], ends: np.ndarray) -> list[bytes]:
    """Ids of parts of words. Those of letters only are encoded many together, as each then ends where a token ends a word."""
    texts = [p.decode() for p in parts]
    plain, rest = [i for i, x in enumerate(texts) if x.isalpha()], [i for i, x in enumerate(texts) if not x.isalpha()]
    out = [b""] * len(parts)
    groups = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
    for group, found in zip(groups, tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(found.ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        if len(cuts) != len(group):  # a letter that lower case turns into a letter and a mark
            rest += group
            continue
        raw, at = ids.tobytes(), 0
        for i, cut in zip(group, (4 * cuts).tolist(), strict=True):
            out[i] = raw[at:cut]
            at = cut
    for i, found in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = array("I", found.ids).tobytes()
    return out


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian 32-bit numbers.

    The tokenizer lower-cases, drops white space, never joins what that separates, and parts letters and numbers from
    signs. So a text's ids are its lower-cased words' ids in order, and a word's those of its body and of the signs
    before and after it; these are encoded once and then looked up. A text with the string of a special token is encoded
    whole, as the tokenizer gives that string its own id.
    """
    tokenizer, caches, known, special, held, ends = _tokenizer(path)
    if held[0] > CACHE:
        caches[:], held[0] = [{}, caches[0]], 0
    cache, old = caches
    own: dict[int, bytes] = {}
    # in any case, since words are lower-cased here before the tokenizer looks for such strings
    whole = [i for i, text in enumerate(texts) if text and any(s[:2] in text and s.lower() in text.lower() for s in special)]
    for i, found in zip(whole, tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
        own[i] = array("I", found.ids).tobytes()
    split = []
    for i, text in enumerate(texts):
        raw = b"" if i in own else (text or "").encode()
        split.append((raw if raw and not raw.isascii() and any(m in text for m in JOINING) else raw.lower()).split())
    unseen = set().union(*split).difference(cache)
    met = {w: old[w] for w in unseen if w in old}
    cache.update(met)
    new = unseen.difference(met)
    if new:
        cuts = {w: (w,) if w.isalnum() else _cut(tokenizer, w, known) for w in new}  # isalnum: ASCII letters and digits only
        parts = set().union(*cuts.values()).difference(cache)
        ordered = sorted(parts.difference(old))
        cache.update({w: old[w] for w in parts if w in old})
        cache.update(zip(ordered, _encode_parts(tokenizer, ordered, ends), strict=True))
        for w, pieces in cuts.items():
            if len(pieces) > 1:
                cache[w] = b"".join(map(cache.__getitem__, pieces))
    out = [own[i] if i in own else b"".join(map(cache.__getitem__, words)) for i, words in enumerate(split)]
    held[0] += 200 * len(unseen) + sum(map(len, new))
    for word in new:
        if len(word) > 100:
            del cache[word]
    return out


def _pieces(path: str | None, size: int, end: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        place = path or public_tokenizers.path("word_bpe_49k.json")
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist(), place), strict=True):
                    ids += closing
                    for piece, start in enumerate(range(0, len(ids) // 4, size)):
                        own = ids[4 * start : 4 * (start + size)]
                        rows.append((doc, piece, start, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            trimmed()

    return run


Bins = list[list[int]]


def best_fit(order: list[int], lengths: list[int], size: int, bins: Bins) -> Bins:
    """Puts pieces, longest first, each into the fullest bin that still has room; opens bins as needed."""
    room = sorted((size - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(order, key=lambda i: -lengths[i]):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = size, len(bins)
            bins.append([i])
        insort(room, (left - lengths[i], k))
    return bins


def fitness(bins: Bins, lengths: list[int], size: int) -> tuple[int, float]:
    """Few bins first, then uneven filling, which leaves bins that can be emptied."""
    return -len(bins), sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins) / max(1, len(bins))


def crossover(a: Bins, b: Bins, lengths: list[int], size: int, rng: np.random.Generator) -> Bins:
    """A child of a with whole bins of b: a stretch of its best-filled ones."""
    filled = sorted(b, key=lambda x: -sum(lengths[i] for i in x))
    to = 1 + int(rng.integers(max(1, len(filled) * 2 // 3)))
    injected = filled[int(rng.integers(to)) : to]
    inside = {i for x in injected for i in x}
    kept = [list(x) for x in a if inside.isdisjoint(x)]
    placed = inside.union(*kept) if kept else inside
    return best_fit([i for i in range(len(lengths)) if i not in placed], lengths, size, [list(x) for x in injected] + kept)


def mutate(a: Bins, lengths: list[int], size: int, rng: np.random.Generator) -> Bins:
    """Empties the worst bin and some others, and best-fits their pieces."""
    by_fill = sorted(range(len(a)), key=lambda k: sum(lengths[i] for i in a[k]))
    out = {*by_fill[:1], *rng.choice(len(a), min(len(a), 3), replace=False).tolist()}
    return best_fit([i for k in out for i in a[k]], lengths, size, [list(x) for k, x in enumerate(a) if k not in out])


def evolve(lengths: list[int], size: int, seed: int, elites: list[Bins]) -> Bins:
    """The best solution after some generations, from elites (own and immigrated) and best-fit starts."""
    rng = np.random.default_rng(seed)
    bound = -(-sum(lengths) // size)
    people = [[list(x) for x in e] for e in elites] or [best_fit(list(range(len(lengths))), lengths, size, [])]
    ranked = max(people, key=lambda p: fitness(p, lengths, size))
    if len(ranked) <= bound or len(lengths) < 3:
        return ranked  # no packing has fewer bins
    while len(people) < POPULATION:
        some = rng.permutation(len(lengths))[: len(lengths) // 2].tolist()
        first: Bins = best_fit(some, lengths, size, [])
        inside = set(some)
        people.append(best_fit([i for i in range(len(lengths)) if i not in inside], lengths, size, first))
    for _ in range(GENERATIONS):
        people.sort(key=lambda p: fitness(p, lengths, size), reverse=True)
        if len(people[0]) <= bound:
            break
        a, b = people[0], people[1 + int(rng.integers(len(people) - 1))]
        people[-1] = crossover(b, a, lengths, size, rng) if rng.random() < 0.5 else mutate(crossover(a, b, lengths, size, rng), lengths, size, rng)
    return max(people, key=lambda p: fitness(p, lengths, size))


def _as_bins(assigned: np.ndarray) -> Bins:
    order = np.argsort(assigned, kind="stable")
    cuts = np.flatnonzero(np.diff(assigned[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


_STATE = "block long, island int, rows array<long>, lengths array<int>, elite array<int>, bins int, fit double"


def _state(block: int, island: int, rows: np.ndarray, lengths: list[int], bins: Bins, size: int) -> dict:
    elite = np.zeros(len(lengths), np.int32)
    for k, b in enumerate(bins):
        elite[b] = k
    return {"block": block, "island": island, "rows": rows, "lengths": np.asarray(lengths, np.int32), "elite": elite, "bins": len(bins), "fit": fitness(bins, lengths, size)[1]}


def _settle(size: int) -> Callable:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True])
        lengths = group["length"].tolist()
        bins = evolve(lengths, size, int(key[0]) * ISLANDS + int(key[1]), [])
        return pd.DataFrame([_state(int(key[0]), int(key[1]), group["row"].to_numpy(), lengths, bins, size)])

    return run


def _meet(size: int, epoch: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                lengths = [int(x) for x in r.lengths]
                elites = [_as_bins(np.asarray(r.elite)), _as_bins(np.asarray(r.immigrant))]
                bins = evolve(lengths, size, epoch * 10**6 + int(r.block) * ISLANDS + int(r.island), elites)
                out.append(_state(int(r.block), int(r.island), np.asarray(r.rows), lengths, bins, size))
            yield pd.DataFrame(out, columns=["block", "island", "rows", "lengths", "elite", "bins", "fit"])

    return run


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """(row, block, bin, fill, offset) for pieces (row long, length): where each goes. row is unique."""
    blocks = max(1, -(-pieces.count() // BLOCK))
    dealt = pieces.select("row", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).alias("block"))
    dealt = dealt.select("*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    first = cut_lineage(dealt.groupBy("block", "island").applyInPandas(_settle(size), _STATE))
    second, bound = first, F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / size)
    for epoch in range(1, EPOCHS):
        open_blocks = second.where(F.col("bins") > bound).select("block").distinct()
        if open_blocks.isEmpty():  # no packing has fewer bins
            break
        travelled = second.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("elite").alias("immigrant"))
        second = cut_lineage(second.join(travelled, ["block", "island"]).mapInPandas(_meet(size, epoch), _STATE))
    best = Window.partitionBy("block").orderBy("bins", F.desc("fit"), "island")
    won = second.withColumn("place", F.row_number().over(best)).where("place = 1")
    placed = won.select("block", F.explode(F.arrays_zip("rows", "lengths", "elite")).alias("p")).select("block", F.col("p.rows").alias("row"), F.col("p.lengths").cast("long").alias("length"), F.col("p.elite").alias("bin"))
    one = Window.partitionBy("block", "bin")
    before = one.orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("row", "block", "bin", F.sum("length").over(one).alias("fill"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length")


def pack_documents(documents: DataFrame, size: int = 4096, end: int = 1, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most `size` tokens.

    Takes (doc_id, text), ignores other columns. A document is its ids, those of special tokens included, and then
    `end`; only longer ones are cut, into pieces of `size`. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id and offset, and ids (bytes of little-endian 32-bit numbers) if asked for. Null texts are empty
    and get the one closing id; null ids and repeated rows are pieces like any other, and pieces of one length are put in
    any order. An empty table gives an empty
    result. tokenizer: a file of the tokenizers library that drops white space.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = cut_lineage(docs.mapInArrow(_pieces(tokenizer, size, end, with_ids), schema).withColumn("row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == size).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = cut_lineage(pack(pieces.where(F.col("length") < size).select("row", "length"), size))
    poor = places.where(F.col("fill") < 0.97 * size)
    again = pack(poor.select("row", "length"), size)
    good = places.where(F.col("fill") >= 0.97 * size)
    numbered = [x.select("row", (F.col("block") * (1 << 20) + F.col("bin") * 2 + k).alias("sequence_id"), "offset") for k, x in enumerate((good, again))]
    where = full.union(numbered[0]).union(numbered[1])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pieces.join(where, "row").select(*names, *["ids"] * with_ids)
