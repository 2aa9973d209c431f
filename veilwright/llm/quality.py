"""Quality by importance resampling: target and raw n-gram models, sampled by Gumbel top-k.

Texts become bags of hashed word unigrams and bigrams.  Two generative models (smoothed bucket
frequencies) are counted, one over the target documents and one over all documents; a
document's log weight is the sum over its n-grams of log(target / raw).  Adding Gumbel noise to
the log weights and keeping the k largest samples k documents without replacement in proportion
to their weights.

Scale: counting is one Arrow pass that emits at most ``BUCKETS`` partial sums a task and model;
models have a fixed size; the k-th largest key is found by a radix selection over histograms of
at most 65,536 bins, exact for any k and N, without sorting or moving texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import NOT_SPACE, Tables, Words, id_and_text, id_bytes, mix, parts, slices, small_side

BUCKETS = 1 << 14
SMOOTHING = 1.0
SEED = 17


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every unigram and bigram of the texts; words end at white space, case is folded."""
    words = Words(texts, NOT_SPACE)
    h = words.hashes()
    pair = words.docs[1:] == words.docs[:-1]
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:])[pair] + np.uint64(1)
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    docs = np.concatenate([words.docs, words.docs[1:][pair]])
    return docs, (np.concatenate([mix(h), mix(two)]) >> shift).astype(np.int64)


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(target, bucket, n): n-gram counts of rows (text, target), summed in tasks and then by bucket."""

    def run(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in parts(batches):
            texts, target = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in slices(texts):
                docs, buckets = ngrams(texts[a:b])
                chosen = target[a:b][docs]
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                counts[1] += np.bincount(buckets[chosen], minlength=BUCKETS)
        for kind in (0, 1):
            held = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), kind, np.int32)), pa.array(held, pa.int32()), pa.array(counts[kind][held])], ["target", "bucket", "n"])

    partial = rows.select("text", "target").mapInArrow(run, "target int, bucket int, n long")
    return partial.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """log(target / raw) for each bucket; both models smoothed; no target texts give zeros."""
    both = np.zeros((2, BUCKETS))
    for kind, bucket, n in counts.collect():  # at most 2 * BUCKETS rows
        both[kind, bucket] = n
    if not both[1].any():
        return np.zeros(BUCKETS)
    share = (both + SMOOTHING) / (both.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def log_weights(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams and log_weight of every row; null and empty texts have no n-grams and weigh 0."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            counts, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for a, b in slices(texts):
                owner, buckets = ngrams(texts[a:b])
                counts[a:b] = np.bincount(owner, minlength=b - a)
                sums[a:b] = np.bincount(owner, shared.value[buckets], b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(np.round(sums, 9))], ["doc_id", "n_grams", "log_weight"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_grams long, log_weight double")


def gumbel(seed: int = SEED):
    """Standard Gumbel noise fixed by doc_id and seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int):
    """The k-th largest value of a long column (k within the row count): four rounds of 16-bit histograms."""
    prefix, left = 0, k
    flipped = F.col(column).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order
    for shift in (48, 32, 16, 0):
        here = rows if shift == 48 else rows.where(F.shiftrightunsigned(flipped, shift + 16) == prefix)
        bins = here.groupBy(F.shiftrightunsigned(flipped, shift).bitwiseAND(65535).alias("bin")).count().collect()
        for value, n in sorted(bins, reverse=True):
            if n >= left:
                break
            left -= n
        prefix = prefix << 16 | value
    return prefix - (1 << 63), left


def resample(docs: DataFrame, target_ids: DataFrame, k: int | None = None, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_grams, log_weight, gumbel_key, selected.

    ``target_ids`` (doc_id) are the documents of the target model.  Of N rows, k (or ``share``
    of N, rounded) are selected; equal keys go by smaller doc_id, then repeated rows of one id
    are selected together.  A null id is a key like any other, never in the target.
    """
    tables = Tables(docs.sparkSession, "quality")
    rows = id_and_text(docs, id_col, text_col)
    target = tables.write(target_ids.select("doc_id").where("doc_id is not null").distinct())
    marked = target.withColumn("target", F.lit(True))
    n_target = target.count()
    joined = rows.join(small_side(marked, n_target, id_bytes(marked, "doc_id")), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratio = log_ratio(bucket_counts(joined))
    key = (F.col("log_weight") + gumbel(seed)).alias("gumbel_key")
    scored = tables.write(log_weights(docs, ratio, id_col, text_col).select("*", key).withColumn("rank", _sortable(F.col("gumbel_key"))))
    n = scored.count()
    k = round(n * (share or 0.0)) if k is None else min(k, n)
    if k <= 0:
        chosen = F.lit(False)
    else:
        edge, left = kth_largest(scored, "rank", k)
        # rows that share the edge nearly always share their id: one counted row each
        last, reached = None, 0
        for tied, times in scored.where(F.col("rank") == edge).groupBy("doc_id").count().orderBy("doc_id").toLocalIterator():
            last, reached = tied, reached + times
            if reached >= left:
                break
        chosen = (F.col("rank") > edge) | ((F.col("rank") == edge) & (F.col("doc_id").isNull() if last is None else F.coalesce(F.col("doc_id") <= last, F.lit(True))))
    return scored.select("doc_id", "n_grams", "log_weight", "gumbel_key", chosen.alias("selected"))


def _sortable(x):
    """A double as a long of the same order, in steps of 2**-32 (keys stay far below 2**30)."""
    return F.round(x * float(1 << 32)).cast("long")
