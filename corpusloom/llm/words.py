"""Word, shingle and window fingerprints of whole texts, computed on Arrow buffers with numpy.

The operators of this subpackage see a text as a sequence of words. Cutting and hashing words one by
one in Python is slow, so a batch of texts is handled as one flat byte array: a lookup table marks
separators, word bounds come from the changes of that mark, and a rolling polynomial over the bytes
gives each word's 64-bit fingerprint. The same trick over word fingerprints gives fingerprints of
windows. All arithmetic is modulo 2**64 and depends on the bytes alone, so executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; one longer text is still handled whole.
SLICE_BYTES = 500_000
_MULT, _MULT2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse."""
    got = _POWERS.get(mult)
    if got is None or len(got[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        both = []
        for base in (mult, pow(mult, -1, 1 << 64)):
            p = np.full(size, base, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        got = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:  # tables for a very long text are not kept
            _POWERS[mult] = got
    return got


class Prefix:
    """Fingerprints of any stretch [start, end) of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, mult: int = _MULT):
        p, self.inverse = powers(mult, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * p[: len(values)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_ASIS, _LOWER = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes separate words: ASCII white space, or (after lower-casing) all ASCII but letters and digits.
_SPACE, _SIGNS = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SIGNS[:48] = _SIGNS[58:97] = _SIGNS[123:128] = True


@dataclass
class Words:
    """Words of a batch of texts, in order. Word i is buffer[start[i]:end[i]]; text d has words offsets[d]:offsets[d+1]."""

    buffer: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]].tobytes()

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def windows(self, size: int) -> np.ndarray:
        """First words of all runs of `size` words inside one text."""
        first = np.arange(len(self))
        return first[first + size <= self.offsets[1:][self.doc]] if len(self) else first


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 bounds of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def cut(column: pa.Array, lower: bool, signs: bool) -> Words:
    """Words of whole texts. signs: letters, digits and non-ASCII make words, else all but white space does."""
    flat, bounds = text_bytes(column)
    flat = (_LOWER if lower else _ASIS)[flat]
    apart = (_SIGNS if signs else _SPACE)[flat]
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = ~apart
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(flat))]  # a text's bound also bounds a word
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    offsets = np.zeros(len(bounds), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(bounds) - 1), out=offsets[1:])
    return Words(flat, bounds, start, end, Prefix(_BYTE[flat]).of(start, end), doc, offsets)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `limit` bytes of the text column."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: pa.Array | np.ndarray) -> np.ndarray:
    return np.asarray(x).astype(np.int64, copy=False).view(U)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    bounds = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
