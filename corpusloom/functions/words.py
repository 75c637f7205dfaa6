"""Words of a batch of texts and their places, by whole columns: numpy and Arrow inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is by itself.
SLICE = 1 << 20

TOKEN = "array<struct<tok:int,word:string,end:bigint>>"
RUN = "array<struct<tok:int,n:int,start:bigint,end:bigint,text:string>>"
PLACE = "array<struct<tok:int,n:int,start:bigint,end:bigint>>"
CONTEXT = "array<struct<tok:int,context:string>>"
WINDOW = "array<struct<tok:int,word:string,near:array<string>,place:int>>"
LABELLED = "array<struct<words:array<string>,labels:array<string>>>"


class Words:
    """White-space words of texts (null: none): row, tok (place in the row), length and end of each (if a row's are joined by one space), and their count by row."""

    def __init__(self, texts: pa.Array) -> None:
        at, data = _bytes(texts)
        white = (data == 32) | ((data >= 9) & (data <= 13))
        begins, lasts = ~white, ~white
        begins[1:] &= white[:-1]
        lasts[:-1] &= white[1:]
        firsts, ends = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
        begins[firsts], lasts[ends] = ~white[firsts], ~white[ends]
        left, right = np.flatnonzero(begins), np.flatnonzero(lasts) + 1
        points = _before((data & 0xC0) != 0x80)
        self.row = np.searchsorted(at, left, side="right") - 1
        self.count = np.bincount(self.row, minlength=len(texts))
        first = _before(self.count)[self.row]
        self.tok = np.arange(len(left)) - first
        self.length = points[right] - points[left]
        sums = _before(self.length + 1)
        self.end = sums[1:] - sums[first] - 1
        self.word = pa.LargeStringArray.from_buffers(len(left), pa.py_buffer(_before(right - left)), pa.py_buffer(data[~white]))

    def run(self, at: np.ndarray, n: int) -> pa.Array:
        """Texts of the n words from each place on."""
        return pc.binary_join_element_wise(*[self.word.take(pa.array(at + k)) for k in range(n)], pa.scalar(" ", pa.large_string()))


def _before(xs: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.concatenate([[0], np.cumsum(xs, dtype=np.int64)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, with the end behind, and all bytes."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = whole.buffers()
    at = np.frombuffer(at, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Rows of about SLICE bytes."""
    return _parts(_bytes(texts)[0][:-1] // SLICE)


def _parts(part: np.ndarray) -> Iterator[slice]:
    """Neighbouring rows of one part."""
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return (slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False))


def _listed(row: np.ndarray, rows: int, columns: dict[str, pa.Array]) -> pa.Array:
    """A list a row of what belongs to it; entries come sorted by row."""
    at = pa.array(_before(np.bincount(row, minlength=rows)), pa.int32())
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def tokens(texts: pa.Array) -> pa.Array:
    """Words of each text, as TOKEN says."""

    def made(part: pa.Array) -> pa.Array:
        w = Words(part)
        return _listed(w.row, len(part), {"tok": pa.array(w.tok, pa.int32()), "word": w.word.cast(pa.string()), "end": pa.array(w.end, pa.int64())})

    return pa.concat_arrays([made(texts[s]) for s in _slices(texts)])


def windows(texts: pa.Array, reach: int) -> pa.Array:
    """Words of each text with those up to `reach` before and behind, and their own place among these, as WINDOW says."""

    def made(part: pa.Array) -> pa.Array:
        w = Words(part)
        place, behind = np.minimum(w.tok, reach), np.minimum(w.count[w.row] - 1 - w.tok, reach)
        n = place + behind + 1
        at = _before(n)
        near = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(np.arange(len(n)) - place, n)
        word = w.word.cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), word.take(pa.array(near)))
        return _listed(w.row, len(part), {"tok": pa.array(w.tok, pa.int32()), "word": word, "near": lists, "place": pa.array(place, pa.int32())})

    return pa.concat_arrays([made(texts[s]) for s in _slices(texts)])


def contexts(texts: pa.Array, reach: int, longest: int, few: int, short: int) -> pa.Array:
    """The context of each word of each text, as CONTEXT says: `sequences.token_context` of the text's own words."""

    def made(part: pa.Array) -> pa.Array:
        w = Words(part)
        words, ends, at, out = w.word.to_pylist(), _before(w.count), 0, []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            whole = b - a <= few and b > a and w.end[b - 1] <= short
            for at in range(a, b):
                low, high = (a, b) if whole else (max(a, at - reach), min(b, at + reach + 1))
                out.append(" ".join([*words[low:at], f"[ENT] {words[at]} [/ENT]", *words[at + 1 : high]])[:longest])
        return _listed(w.row, len(part), {"tok": pa.array(w.tok, pa.int32()), "context": pa.array(out, pa.string())})

    return pa.concat_arrays([made(texts[s]) for s in _slices(texts)])


def _found(w: Words, most: int, wanted: Callable[..., np.ndarray], value: pa.Array | None) -> list[np.ndarray]:
    """For each length, the words at which wanted runs begin."""
    there = np.ones(len(w.count), bool) if value is None else value.is_valid().to_numpy(zero_copy_only=False)
    value = None if value is None else value.fill_null(0).to_numpy(zero_copy_only=False)
    found = []
    for n in range(1, most + 1):
        at = np.flatnonzero((w.tok + n <= w.count[w.row]) & there[w.row])
        found.append(at[wanted(w.tok[at], n, *([] if value is None else [value[w.row[at]]]))])
    return found


def runs(texts: pa.Array, most: int, wanted: Callable[..., np.ndarray], given: pa.Array | None = None, text: bool = True) -> pa.Array:
    """Runs of 1 to `most` words of each text for which wanted(tok, n) holds, or wanted(tok, n, value) with the text's given value (null: no runs), as RUN says; without text, as PLACE says."""

    def made(part: pa.Array, value: pa.Array | None) -> pa.Array:
        w = Words(part)
        found = _found(w, most, wanted, value)
        at, n = np.concatenate(found), np.repeat(np.arange(1, most + 1), [len(x) for x in found])
        order = np.argsort(w.row[at], kind="stable")
        own = {"text": pa.concat_arrays([w.run(x, i + 1) for i, x in enumerate(found)]).take(pa.array(order)).cast(pa.string())} if text else {}
        at, n = at[order], n[order]
        columns = {"tok": pa.array(w.tok[at], pa.int32()), "n": pa.array(n, pa.int32()), "start": pa.array(w.end[at] - w.length[at], pa.int64()), "end": pa.array(w.end[at + n - 1], pa.int64())}
        return _listed(w.row[at], len(part), columns | own)

    return pa.concat_arrays([made(texts[s], None if given is None else given[s]) for s in _slices(texts)])


def free(at: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which runs of n words from a place on begin behind all that come before them in their row, by first word and the longest first; in that order."""
    order = np.lexsort((-n, at))
    at, end, row = at[order], (at + n)[order], row[order]
    alone = np.ones(len(at), bool)
    alone[1:] = (at[1:] >= np.maximum.accumulate(end)[:-1]) | (row[1:] != row[:-1])
    return order[alone]


def labelled(texts: pa.Array, most: int, wanted: Callable[..., np.ndarray], kind: Callable[..., np.ndarray], kinds: tuple[str | None, ...], given: pa.Array) -> pa.Array:
    """Words of each text that has runs (see `runs`), with BILOU labels of the free ones, as LABELLED says: U alone, B first, L last, I between, O outside. kind(tok, n, value): a run's place in kinds."""
    names = pa.array(["O", *(k and f"{sign}-{k}" for k in kinds for sign in "BILU")], pa.string())

    def made(part: pa.Array, value: pa.Array) -> pa.Array:
        w = Words(part)
        found = _found(w, most, wanted, value)
        at, n = np.concatenate(found), np.repeat(np.arange(1, most + 1), [len(x) for x in found])
        some = np.bincount(w.row[at], minlength=len(part)) > 0
        kept = free(at, n, w.row[at])
        at, n = at[kept], n[kept]
        first = 1 + 4 * kind(w.tok[at], n, value.fill_null(0).to_numpy(zero_copy_only=False)[w.row[at]]).astype(np.int64)
        label = np.zeros(len(w.tok), np.int64)
        inside = np.arange(n.sum()) - np.repeat(_before(n)[:-1], n)
        label[np.repeat(at, n) + inside] = np.repeat(first, n) + np.where(inside == 0, 0, np.where(inside == np.repeat(n, n) - 1, 2, 1))
        label[at[n == 1]] = first[n == 1] + 3
        mine = some[w.row]
        bounds = pa.array(_before(w.count[some]), pa.int32())
        lists = {"words": pa.ListArray.from_arrays(bounds, w.word.filter(pa.array(mine)).cast(pa.string())), "labels": pa.ListArray.from_arrays(bounds, names.take(pa.array(label[mine])))}
        return _listed(np.flatnonzero(some), len(part), lists)

    return pa.concat_arrays([made(texts[s], given[s]) for s in _slices(texts)])


def cells(blocks: pa.Array) -> pa.Array:
    """Of each block's lines that aren't blank the first and the last of the columns that tabs or spaces part, as words and labels, as LABELLED says."""

    def made(part: pa.Array) -> pa.Array:
        lines = pc.split_pattern(part.cast(pa.large_string()), "\n")
        flat, row = lines.flatten(), pc.list_parent_indices(lines)
        there = pc.not_equal(pc.utf8_trim(flat, " "), "")
        flat, row = pc.replace_substring(flat.filter(there), " ", "\t"), row.filter(there).to_numpy()
        before, behind = pc.split_pattern(flat, "\t", max_splits=1), pc.split_pattern(flat, "\t", max_splits=1, reverse=True)
        firsts, lasts = before.offsets.to_numpy()[:-1], behind.offsets.to_numpy()[1:] - 1
        bounds = pa.array(_before(np.bincount(row, minlength=len(part))), pa.int32())
        column = lambda parts, at: pa.ListArray.from_arrays(bounds, parts.values.take(pa.array(at)).cast(pa.string()))
        return _listed(np.arange(len(part)), len(part), {"words": column(before, firsts), "labels": column(behind, lasts)})

    return pa.concat_arrays([made(blocks[s]) for s in _slices(blocks)])


def scored(texts: pa.Array, given: tuple[pa.Array, ...], score: Callable[..., np.ndarray]) -> pa.Array:
    """For each text a list of its words' scores: score(tok, *values) gives a row a word, from its place and the text's given values (null in one: null scores)."""

    def made(part: pa.Array, values: list[pa.Array]) -> pa.Array:
        w = Words(part)
        plain = [v.fill_null(0).to_numpy(zero_copy_only=False)[w.row] for v in values]
        known = np.logical_and.reduce([np.ones(len(part), bool), *[v.is_valid().to_numpy(zero_copy_only=False) for v in values]])[w.row]
        rows = np.asarray(score(w.tok, *plain), np.float64)
        flat = pa.array(rows.ravel(), mask=np.repeat(~known, rows.shape[1]))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat)
        return pa.ListArray.from_arrays(pa.array(_before(w.count), pa.int32()), inner)

    return pa.concat_arrays([made(texts[s], [v[s] for v in given]) for s in _slices(texts)])


def decoded(scores: pa.Array, labels: tuple[str, ...], allowed: np.ndarray) -> pa.Array:
    """The best label of each token of lists of scores that allowed[before, label] lets follow; before: 0 at the beginning, else 1 and the place of the label before.

    For each token it is worked out which label would follow each one before. These tables are put together by pairs,
    fours and so on, until a token's label is the same whatever came before; so a long list takes few steps.
    """

    def made(part: pa.Array) -> pa.Array:
        count = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
        rows = part.flatten()
        if rows.null_count:
            rows = pa.concat_arrays([rows, pa.array([[None] * len(labels)], rows.type)]).take(pa.array(np.where(rows.is_null(), len(rows), np.arange(len(rows)))))
        flat = pc.fill_null(rows.flatten(), -np.inf).to_numpy(zero_copy_only=False).reshape(-1, len(labels))
        follows = np.stack([np.argmax(np.where(ok, flat, -np.inf), 1) for ok in allowed], 1)
        first = _before(count)[:-1][count > 0]
        follows[first] = follows[first][:, :1]
        step, left = 1, np.flatnonzero((follows != follows[:, :1]).any(1))
        while len(left):
            follows[left] = np.take_along_axis(follows[left], follows[left - step] + 1, 1)
            step, left = step * 2, left[(follows[left] != follows[left, :1]).any(1)]
        chosen = pa.array(labels, pa.string()).take(pa.array(follows[:, 0]))
        return pa.ListArray.from_arrays(pa.array(_before(count), pa.int32()), chosen, mask=part.is_null())

    sizes = _before(pc.fill_null(pc.list_value_length(scores), 0).to_numpy(zero_copy_only=False))
    return pa.concat_arrays([made(scores[s]) for s in _parts(sizes[:-1] // SLICE)])
