"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (FTRL-proximal) under an elastic net, on a bounded sample of
labelled rows for each language; a part of the sample is kept back for the temperature that calibrates
probabilities. Document frequencies come from all training rows. Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, held_out, sampled, trimmed

#: Hashed n-gram features.
FEATURES = 1 << 14
#: Labelled rows of one language used for fitting.
SAMPLE = 800
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and counts of a whole text's character n-grams (1 to 3, other signs as one space); None without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    chars = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other signs, the first after a letter
    chars = np.concatenate([[np.uint32(32)], chars[keep], [np.uint32(32)]]).astype(np.uint64)
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    uni = b * one
    bi = uni + (c + np.uint64(1)) * two
    tri = bi + (a + np.uint64(1)) * three
    hashed = np.concatenate([uni, bi, tri])
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    counts = np.bincount((hashed >> np.uint64(50)).astype(np.int64), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    """classes, weights (features x classes), biases, inverse document frequencies and temperature."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = weigh(at, counts, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if grams is None or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(np.argmax(p))
        return self.classes[best], float(p[best])


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal. rows: features, values, class. Returns weights and biases."""
    size = FEATURES + 1  # the last is the bias
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, label = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(slice(None))
    return w[:-1], w[-1]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts; feature -1 counts texts."""
    total, texts = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            grams = ngrams(text.as_py())
            if grams is not None:
                total[grams[0]] += 1
                texts += 1
    trimmed()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], texts))], ["feature", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t.as_py()) for t in batch.column("text")]
        packed = [None if g is None else np.stack([g[0], g[1]]).astype("<i4").tobytes() for g in found]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(packed, pa.binary())], ["lang", "doc_id", "grams"])
    trimmed()


def fit(documents: DataFrame, train: Column, sample: int = SAMPLE) -> LanguageModel:
    """Fits on rows of (doc_id, text, lang) where `train` holds and text and lang are not null.

    `sample` bounds the labelled rows of one language that set weights and temperature (those with the least hashes of
    doc_id and text); document frequencies cover all training rows. Languages are the distinct labels; of equally likely
    ones the first by name is predicted.
    """
    rows = documents.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    classes = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not classes:
        return LanguageModel([], np.zeros((FEATURES, 0)), np.zeros(0), np.ones(FEATURES), 1.0)
    counted = rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()
    df, total = np.zeros(FEATURES), 0
    for r in counted:
        if r.feature < 0:
            total = r.df
        else:
            df[r.feature] = r.df
    idf = np.log((1 + total) / (1 + df)) + 1
    chosen = sampled(rows, sample, 11, ["doc_id", "text"], ["lang"]).select("lang", "doc_id", "text").mapInArrow(_features, "lang string, doc_id long, grams binary").where("grams is not null")
    data = []
    for r in sorted(chosen.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.lang)):
        at, counts = np.frombuffer(r.grams, "<i4").reshape(2, -1)
        data.append((at.astype(np.int64), weigh(at, counts, idf), classes.index(r.lang)))
    keep_back = [x for i, x in enumerate(data) if i % 5 == 4] if len(data) >= 50 else []
    main = [x for i, x in enumerate(data) if i % 5 != 4] if keep_back else data
    weights, bias = ftrl(main, len(classes), epochs=max(3, 3000 // max(1, len(main))))
    temperature = 1.0
    if keep_back:
        logits = np.array([x @ weights[at] + bias for at, x, _ in keep_back])
        label = np.array([c for _, _, c in keep_back])
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in np.geomspace(0.2, 5, 60)}
        temperature = float(min(loss, key=loss.__getitem__))
    return LanguageModel(classes, weights, bias, idf, temperature)


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """documents with lang_pred and score: the likeliest learned language and its calibrated probability.

    Only text is read. A null text, one without letters, and any text if nothing was learned get `und` and 0. Other
    columns pass through; columns named like the added ones give way. An empty table gives an empty result.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # some hundred KB a language, whatever the corpus

    def prepare():
        found = shared.value

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            guesses = [found.predict(t.as_py()) for t in part.column("text")]
            return [pa.array([g[0] for g in guesses], pa.string()), pa.array([g[1] for g in guesses], pa.float64())]

        return work

    return add_columns(documents, prepare, {"lang_pred": "string", "score": "double"})


def predict_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the rows that are not held out."""
    model = fit(documents, ~held_out(F.col("doc_id")))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
