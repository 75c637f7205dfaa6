"""Target-distribution importance resampling: documents drawn by how much likelier their n-grams are in a target.

A slice of texts gets an integer dictionary of its distinct words; an n-gram is a tuple of such ids, told as the pair of
the n-gram before its last word and that word's id. Each distinct tuple's bytes are hashed once, a word's bytes behind
what stands before it, and occurrences get their bucket by a lookup. Counts by bucket are summed in each task, then by
Spark; no feature is shuffled, and what every task has to know is one gain a bucket. The draw adds Gumbel noise from the
id's digest to a document's mean gain and takes the highest, so it needs no weighted sampling and repeats exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, cut_lineage, numbered, released
from .words import Words, cut, slices

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 2
#: Percent of the documents to draw, the words that one of them has at least, and the seed of the noise.
SHARE, LEAST_WORDS, SEED = 25, 20, 7


def features(words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, crc32 of the feature's bytes) of all runs of 1 to `longest` words inside one text, length by length."""
    _, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    spelled = [b" " + words.word(i) for i in first]
    hashes = np.fromiter((zlib.crc32(w[1:]) for w in spelled), np.int64, len(spelled))
    tuples = ids.copy()  # of the run that starts at a word
    yield np.arange(len(words)), hashes[ids]
    for n in range(2, longest + 1):
        at = words.windows(n)
        pairs, found = np.unique(tuples[at] * len(spelled) + ids[at + n - 1], return_inverse=True)
        shorter, last = np.divmod(pairs, max(1, len(spelled)))
        hashes = np.fromiter(map(zlib.crc32, [spelled[i] for i in last.tolist()], hashes[shorter].tolist()), np.int64, len(pairs))
        tuples[at] = found
        yield at, hashes[found]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): features of all whole texts by bucket, summed in each task first. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, hashes in features(cut(part.column(0), lower=True, signs=True), longest):
                    sums += np.bincount(hashes % buckets, minlength=buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """By bucket, 1000 times the logarithm of its share of the target's features over its share of the documents', rounded down; one is added to every count."""
    spark = docs.sparkSession
    ours, theirs = (bucket_counts(df, buckets, longest) for df in (docs, target))
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(ours.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    both = cut_lineage(both)
    whole = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    likelier = ((F.col("t") + 1.0) * float(whole.s + buckets)) / ((F.col("s") + 1.0) * float(whole.t + buckets))
    found = both.select("bucket", F.floor(1000 * F.log(likelier)).cast("long").alias("gain")).collect()  # one row a bucket
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in found]] = [r.gain for r in found]
    return out


def importance_scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """docs with n_words, n_features and weight, the mean gain of a document's features rounded down.

    docs and target have a column text. Null, empty and wordless texts have no features and weight 0, and so have all
    where the target and the documents are alike; an empty target is all pseudo-counts. Rows are judged one by one, so
    repeated rows and ids and null ids change nothing but the counts. Columns of docs with an added name give way.
    """
    gain = gains(docs, target, buckets, longest)

    def prepare() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            words = cut(batch.column("text"), lower=True, signs=True)
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, hashes in features(words, longest):
                owner = words.doc[at]
                n += np.bincount(owner, minlength=len(n))
                total += np.bincount(owner, gain[hashes % buckets], minlength=len(n)).astype(np.int64)  # whole numbers below 2**53
            return [pa.array(words.lengths()), pa.array(n), pa.array(total // np.maximum(n, 1))]

        return work

    return add_columns(docs, prepare, {"n_words": "long", "n_features": "long", "weight": "long"})


def draw(scored: DataFrame, share: int = SHARE, least_features: int = 2 * LEAST_WORDS - 1, seed: int = SEED) -> DataFrame:
    """scored with score, the weight with noise, and rank: from 1, in the order of scores, of the rows that are drawn, else null.

    scored: doc_id, n_features, weight, any others. Of the N rows with enough features, floor(share * N / 100) are drawn;
    equal scores go by doc_id, null last. Rows with one id have the same noise, and those alike in all else come in any
    order. A null id is read as the text null. No row: no result.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    kept = [c for c in scored.columns if c.lower() not in {"score", "rank"}]
    rows = cut_lineage(scored.select(*[F.col(f"`{c}`") for c in kept], (F.col("weight") + noise).cast("long").alias("score")))
    able = F.coalesce(F.col("n_features"), F.lit(0)) >= least_features
    placed = numbered(rows.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")])
    most = placed.count() * share // 100
    rank = F.when(F.col("position") < most, F.col("position") + 1).cast("long").alias("rank")
    return placed.select(*rows.columns, rank).union(rows.where(~able).select("*", F.lit(None).cast("long").alias("rank")))
