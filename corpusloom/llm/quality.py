"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted shallow trees are grown on labelled rows; every path from a root is a conjunctive rule over statistics. A lasso
logistic fit keeps few of them with weights, and these are compiled into one Spark column expression, so scoring is a
projection of the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage, held_out, sampled
from .words import cut, slices, text_bytes

#: Labelled rows used for fitting (about; those with the least hash), trees, their depth, and candidate thresholds of a statistic.
SAMPLE, TREES, DEPTH, CUTS = 6000, 24, 3, 24
STATISTICS = ("bytes", "words", "word_length", "longest_word", "upper", "digits", "marks", "symbols", "stops", "foreign", "spaces", "newlines", "distinct_words", "commonest_word", "repeated_next", "short_words", "upper_words", "symbol_words", "distinct_lines")

_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, 65:91] = True  # upper
_CLASSES[1, 48:58] = True  # digits
_CLASSES[2, [33, 44, 58, 59, 63, 34, 39, 40, 41, 45]] = True  # marks
_CLASSES[3, [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = True  # symbols
_CLASSES[4, 46] = True  # full stops
_CLASSES[5, 128:] = True  # not ASCII
_CLASSES[6, [32, 9]] = True  # spaces


def _top(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and how often its commonest one stands there."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], np.diff(np.append(at, len(doc))))
    return np.bincount(doc[at], minlength=n), most


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = part.num_rows
            flat, bounds = text_bytes(part.column("text"))
            size = np.diff(bounds)
            per_byte = 1 / np.maximum(size, 1)
            words = cut(part.column("text"), lower=False, signs=False)
            count = words.lengths()
            per_word = 1 / np.maximum(count, 1)

            def within(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(mask)])
                return sums[at[1:]] - sums[at[:-1]]

            classes = [within(c[flat], bounds) * per_byte for c in _CLASSES]
            newline = flat == 10
            lines = within(newline, bounds) + 1
            length = words.end - words.start
            longest = np.zeros(n, np.int64)
            np.maximum.at(longest, words.doc, length)
            distinct, commonest = _top(words.doc, words.hash, n)
            again = np.zeros(len(words), bool)
            again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])

            def of_words(mask: np.ndarray) -> np.ndarray:
                return np.bincount(words.doc, weights=mask, minlength=n) * per_word

            last = flat[words.end - 1]
            begin = np.sort(np.concatenate([bounds[:-1], np.flatnonzero(newline) + 1]))
            line_doc = np.minimum(np.searchsorted(bounds, begin, "right") - 1, n - 1)
            line_end = np.minimum(np.append(begin[1:], len(flat)), bounds[1:][line_doc])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash, dtype=np.uint64)])
            print_ = sums[np.searchsorted(words.start, line_end)] - sums[np.searchsorted(words.start, np.minimum(begin, line_end))]
            distinct_lines, _ = _top(line_doc, print_, n)
            values = [
                size, count, np.bincount(words.doc, weights=length, minlength=n) * per_word, longest, *classes, lines * per_word, distinct * per_word, commonest * per_word, of_words(again),
                of_words(length <= 3), of_words(_CLASSES[0][flat[words.start]] & _CLASSES[0][last] | (last == 33)), of_words(_CLASSES[3][last]), distinct_lines / lines,
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.asarray(v, np.float64)) for v in values)], ["doc_id", *STATISTICS])


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and STATISTICS of whole texts; those of a null text are those of an empty one."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, threshold


def _tree(x: np.ndarray, gain: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: Rule, rules: list[Rule], out: np.ndarray, rate: float) -> None:
    """Grows a least-squares tree on pseudo-residuals; adds all paths to rules and the leaves' means to out."""
    best, split = 1e-9, None
    if depth and len(rows) >= 20:
        target = gain[rows]
        total, n = target.sum(), len(rows)
        for j, thresholds in enumerate(cuts):
            if not len(thresholds):
                continue
            place = np.searchsorted(thresholds, x[rows, j], "left")  # at most threshold k: place <= k
            below = np.cumsum(np.bincount(place, minlength=len(thresholds) + 1))[:-1]
            sums = np.cumsum(np.bincount(place, weights=target, minlength=len(thresholds) + 1))[:-1]
            ok = (below >= 8) & (n - below >= 8)
            won = np.where(ok, sums**2 / np.maximum(below, 1) + (total - sums) ** 2 / np.maximum(n - below, 1) - total**2 / n, 0)
            k = int(np.argmax(won))
            if won[k] > best:
                best, split = float(won[k]), (j, float(thresholds[k]))
    if split is None:
        out[rows] += rate * gain[rows].mean()
        return
    j, threshold = split
    for above in (False, True):
        part = rows[(x[rows, j] > threshold) == above]
        longer = (*path, (j, above, threshold))
        rules.append(longer)
        _tree(x, gain, cuts, part, depth - 1, longer, rules, out, rate)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    on = np.ones(len(x), bool)
    for j, above, threshold in rule:
        on &= (x[:, j] > threshold) == above
    return on


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty by accelerated proximal gradient."""
    n, m = z.shape
    weights, ahead, bias, t = np.zeros(m), np.zeros(m), 0.0, 1.0
    rate = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / n + 1)
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(z @ ahead + bias, -30, 30))) - y
        new = ahead - rate * (z.T @ gap) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        bias -= rate * gap.mean()
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - weights)
        weights, t = new, after
    return weights, bias


@dataclass
class RuleModel:
    """Weighted rules and an intercept on the log-odds."""

    rules: list[Rule]
    weights: list[float]
    bias: float

    def expression(self) -> Column:
        """The score as a column over STATISTICS."""
        odds = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            on = F.lit(True)
            for j, above, threshold in rule:
                on = on & ((F.col(STATISTICS[j]) > threshold) if above else (F.col(STATISTICS[j]) <= threshold))
            odds = odds + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighted by lasso; the penalty is chosen on a fifth of the rows."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 0.02, 0.98)
    odds = np.full(len(y), np.log(share / (1 - share)))
    rules: list[Rule] = []
    rng = np.random.default_rng(5)
    for _ in range(TREES):
        rows = np.flatnonzero(rng.random(len(y)) < 0.7) if len(y) > 200 else np.arange(len(y))
        _tree(x, y - 1 / (1 + np.exp(-odds)), cuts, rows, DEPTH, (), rules, step := np.zeros(len(y)), 1.2)
        odds += step
    rules = list(dict.fromkeys(rules))
    z = np.stack([_holds(r, x) for r in rules], 1).astype(float)
    keep = np.flatnonzero((z.mean(0) > 0) & (z.mean(0) < 1))
    rules, z = [rules[k] for k in keep], z[:, keep]
    back = np.arange(len(y)) % 5 == 4
    scores = {}
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, b = _lasso(z[~back], y[~back], penalty, 200)
        p = np.clip(1 / (1 + np.exp(-(z[back] @ w + b))), 1e-6, 1 - 1e-6)
        scores[penalty] = -(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean()
    w, b = _lasso(z, y, min(scores, key=scores.__getitem__))
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleModel([rules[k] for k in used], [float(w[k]) for k in used], float(b))


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of (doc_id, text) rows, learned from labels (doc_id, quality 0 or 1).

    Held-out rows are never learned from; `sample` bounds the labelled rows that are, chosen by the hash of doc_id. Only
    statistics of the whole text enter the score: an empty or null text has one too. Null ids are scored but not
    learned from; labels that are null or neither 0 nor 1 are left out. Without labels of both kinds, all rows get
    one score. Other columns are ignored; an empty table gives an empty result.
    """
    measured = cut_lineage(statistics(documents))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = sampled(known, sample, 5, ["doc_id", "quality"])
    rows = sorted(measured.join(chosen, "doc_id").select("doc_id", "quality", *STATISTICS).collect())
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(STATISTICS))
    model = fit(x, np.array([r[1] for r in rows], float))
    score = model.expression()
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
