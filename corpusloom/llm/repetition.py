"""Quality rules on repetition: characters inside repeated n-grams and lines of a text, by rolling hashes.

Words are hashed once; the fingerprint of a window of any length comes from running sums over them, so that all lengths
cost one subtraction a word. A window's repeats are found by sorting fingerprints inside a slice of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import add_columns
from .words import _BYTE, Prefix, U, Words, cut, mix, text_bytes

#: Percent of a text's word characters that may stand in its commonest n-gram, in n-grams that stood in it before, and in lines that did.
MOST_IN_TOP = {2: 20, 3: 18, 4: 16}
MOST_REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST_IN_LINES = 20
#: Places from which on a window can be the commonest one: two say little about a short text.
LEAST_PLACES = 3
#: The base rule: words that a text has at least, and the percent of them that may stand in 5-word windows found twice.
LEAST_WORDS, BASE_WINDOW, MOST_IN_WINDOWS = 10, 5, 20
SYMBOLS = "#*$%&|<>"


def _of_document(prints: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Fingerprints that are equal inside one document only."""
    return mix(prints + owner.astype(U) * U(0x9E3779B97F4A7C15))


def _covered(words: Words, first: np.ndarray, size: int) -> np.ndarray:
    """Which words stand in one of the windows that begin at `first`."""
    steps = np.zeros(len(words) + 1, np.int64)
    steps[first] += 1
    steps[first + size] -= 1
    return np.cumsum(steps)[:-1] > 0


def _ends(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks by row, for rows of the given bounds."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _lines(flat: np.ndarray, bounds: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, document) of each line with a word that is equal to an earlier one of its text."""
    breaks = np.concatenate([[-1], np.flatnonzero(flat == 10), [len(flat)]])
    line = np.searchsorted(breaks, words.start)  # of the break behind a word
    low = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(words.doc, prepend=-1) != 0))
    high, owner = np.append(low[1:], len(words)).astype(np.int64), words.doc[low]
    start = np.maximum(breaks[line[low] - 1] + 1, bounds[owner])
    end = np.minimum(breaks[line[low]], bounds[owner + 1])
    _, first = np.unique(_of_document(Prefix(_BYTE[flat]).of(start, end), owner), return_index=True)
    again = np.ones(len(low), bool)
    again[first] = False
    return low[again], high[again], owner[again]


def score_repetition(docs: DataFrame, top: dict[int, int] | None = None, repeated: dict[int, int] | None = None, in_lines: int = MOST_IN_LINES) -> DataFrame:
    """docs with counts of words, symbols and repeats, and the verdict `kept`.

    Words are runs of other than ASCII white space; characters are code points of words. n_dup_lines and dup_line_chars
    count lines with a word that equal an earlier line; n_repeat_words, words in 5-word windows found twice or more, the
    first included; dup_chars_N, characters in N-word windows that stood in the text before; top_chars_N, those of all
    places of the N-word window that has most, among windows with three places (places that overlap count each). base_failed: fewer
    than 10 words, or more than 20 percent of them in windows found twice. kept: neither that, nor a share of characters
    above its limit (in percent by N: `top`, `repeated`; lines: `in_lines`); a share of just the limit is kept.

    Null, empty and wordless texts have zeros and fail. Each row is judged by itself, whole and whatever its length, so
    repeated rows and null ids get the same values. Columns of docs with an added name give way. No row: no result.
    """
    top, repeated = MOST_IN_TOP if top is None else top, MOST_REPEATED if repeated is None else repeated
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS.encode())] = True
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = {c: "long" for c in counts} | {"base_failed": "boolean", "kept": "boolean", "dup_line_chars": "long"} | {f"dup_chars_{n}": "long" for n in repeated} | {f"top_chars_{n}": "long" for n in top}

    def prepare() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column("text")
            rows = batch.num_rows
            flat, bounds = text_bytes(column)
            words = cut(column, lower=False, signs=False)
            begun = np.zeros(len(flat) + 1, np.int64)  # code points before a byte
            np.cumsum((flat & 0xC0) != 0x80, out=begun[1:])
            chars = begun[words.end] - begun[words.start]
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(chars, out=before[1:])
            word_chars = before[words.offsets[1:]] - before[words.offsets[:-1]]
            by_row = lambda owner, weights=None: np.bincount(owner, weights, minlength=rows).astype(np.int64)
            n_words = words.lengths()
            window = Prefix(words.hash)
            low, high, owner = _lines(flat, bounds, words)
            line_chars = by_row(owner, before[high] - before[low])
            good = 100 * line_chars <= in_lines * word_chars
            out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _ends(symbols[flat], bounds), "n_dup_lines": by_row(owner), "dup_line_chars": line_chars}
            for n in sorted({*top, *repeated, BASE_WINDOW}):
                at = words.windows(n)
                _, first, kind, often = np.unique(_of_document(window.of(at, at + n), words.doc[at]), return_index=True, return_inverse=True, return_counts=True)
                if n == BASE_WINDOW:
                    twice = _covered(words, at[often[kind] > 1], n)
                    out["n_repeat_words"] = by_row(words.doc[twice])
                if n in repeated:
                    again = np.ones(len(at), bool)
                    again[first] = False
                    inside = _covered(words, at[again], n)
                    out[f"dup_chars_{n}"] = by_row(words.doc[inside], chars[inside])
                    good &= 100 * out[f"dup_chars_{n}"] <= repeated[n] * word_chars
                if n in top:
                    most = np.zeros(rows, np.int64)
                    many = often >= LEAST_PLACES
                    place = at[first[many]]
                    np.maximum.at(most, words.doc[place], often[many] * (before[place + n] - before[place]))
                    out[f"top_chars_{n}"] = most
                    good &= 100 * most <= top[n] * word_chars
            out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_IN_WINDOWS * n_words)
            out["kept"] = good & ~out["base_failed"]
            return [pa.array(out[name]) for name in added]

        return work

    return add_columns(docs, prepare, added)
