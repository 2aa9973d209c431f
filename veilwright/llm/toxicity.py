"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the presence of hashed words and word beginnings is trained in numpy from
confirmed toxic documents (positive) and other documents (unlabelled, toxic ones among them) by
minimising the class-prior-corrected risk  p R_pos(+) + max(0, R_unl(-) - p R_pos(-)).

Words become features by their document frequencies, counted over all usable texts.  The gradient
steps read a bounded sample: at most ``max_positive`` confirmed and ``max_unlabelled`` other rows,
the smallest by a hash of the id, each as at most ``FEATURES`` numbers.  Settings of the training
are chosen by the corrected risk on a part of that sample, never on held-out rows.  Scoring is one
row-local Arrow pass over every whole text with a model of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import ALPHANUMERIC, Tables, Words, id_and_text, id_bytes, mix, parts, slices, small_side

BITS = 20
PREFIXES = (4, 5, 6)
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
FEATURES = 4_096
#: Settings tried; those with the least risk on the inner validation rows are used: weight decay, how far below zero, as a
#: share of the prior, the corrected risk may fall before a step is taken back, and the number of steps.
DECAYS = (3e-5, 3e-4, 3e-3)
SLACKS = (0.0, 0.2)
STEPS = (150, 300, 600)
INNER_FOLDS = 5
#: A bucket becomes a feature if positives hold it more often than clean texts do by so many deviations.
GAIN = 6.0
THRESHOLD = 0.7
SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one float32 for each of 2**bits buckets, mostly zero
    bias: float
    bits: int = BITS

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        wanted = self.weights != 0
        for a, b in slices(texts, SLICE):
            docs, buckets = features(texts[a:b], self.bits, wanted)
            margin = self.bias + np.bincount(docs, self.weights[buckets], b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        return out


def features(texts: list[str | None], bits: int = BITS, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs of the texts' words and word beginnings."""
    words = Words(texts, ALPHANUMERIC)
    lengths = words.ends - words.starts
    docs, buckets = [], []
    for k in (None, *PREFIXES):
        h = words.hashes(k)
        keep = slice(None) if k is None else lengths > k
        mixed = mix(h[keep] ^ np.uint64(0 if k is None else k * 0x1000193)) >> np.uint64(64 - bits)
        owners = words.docs[keep]
        if wanted is not None:
            hit = wanted[mixed]
            mixed, owners = mixed[hit], owners[hit]
        docs.append(owners)
        buckets.append(mixed)
    pairs = np.unique(np.concatenate(docs).astype(np.int64) << bits | np.concatenate(buckets).astype(np.int64))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def _frequencies(rows: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """(bucket, n): the number of texts that hold each (wanted) bucket, summed in tasks and then by bucket."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(None if wanted is None else np.packbits(wanted))  # 128 kB

    def run(batches):
        only = None if shared.value is None else np.unpackbits(shared.value).astype(bool)
        counts = np.zeros(1 << BITS, np.int64)
        for batch in parts(batches):
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, SLICE):
                here, n = np.unique(features(texts[a:b], BITS, only)[1], return_counts=True)
                counts[here] += n
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], ["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(frequencies: DataFrame) -> np.ndarray:
    out = np.zeros(1 << BITS, np.int64)
    found = frequencies.toArrow()  # at most one row a bucket
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _hashed(rows: DataFrame, kept: np.ndarray) -> DataFrame:
    """label, fold and the packed features of each text, as sorted places in ``kept``."""
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def run(batches):
        place = np.full(1 << BITS, -1, np.int64)
        place[shared.value] = np.arange(len(shared.value))
        for batch in parts(batches):
            texts, packed = batch.column(0).to_pylist(), []
            for a, b in slices(texts, SLICE):
                docs, buckets = features(texts[a:b], BITS, place >= 0)
                cuts = np.searchsorted(docs, np.arange(b - a + 1))
                packed += [place[buckets[cuts[k] : cuts[k + 1]]].astype(np.uint16).tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], ["label", "fold", "places"])

    return rows.select("text", "label", "fold").mapInArrow(run, "label int, fold int, places binary")


def train(docs: DataFrame, labels: DataFrame, usable=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from rows of ``labels`` (id_col, label_col; 1 means toxic) and all other texts as unlabelled ones.

    ``usable`` is a condition on doc_id for rows that may be learned from.  The class prior is the
    share of positives among usable labelled rows.  ``max_positive`` and ``max_unlabelled`` bound the
    sample that the gradient steps read; word frequencies come from all usable rows.  Ids labelled more than
    once count as positive if any row says so; ties of the sampling hash go by id; repeated rows of a
    sampled id all count.  Without positives or without texts the model scores every text zero-ish (its bias).
    """
    tables = Tables(docs.sparkSession, "toxicity")
    rows = id_and_text(docs, id_col, text_col)
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null")
    if usable is not None:
        rows, marks = rows.where(usable), marks.where(usable)
    marks = tables.write(marks.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    prior = marks.agg(F.avg("label")).first()[0] or 0.0
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    positive = tables.write(marks.where("label = 1").select("doc_id").orderBy(order, "doc_id").limit(max_positive).withColumn("label", F.lit(1)))
    unlabelled = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(max_unlabelled).withColumn("label", F.lit(0))
    sample = positive.union(tables.write(unlabelled))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.lit(INNER_FOLDS)).cast("int").alias("fold")
    picked = tables.write(rows.join(small_side(sample, max_positive + max_unlabelled, id_bytes(sample, "doc_id")), "doc_id").select("text", "label", fold))
    sizes = {r.label: r.n for r in picked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model(np.zeros(1 << BITS, np.float32), -4.0)
    if len(sizes) < 2:
        return nothing
    df_p = _counts(_frequencies(picked.where("label = 1")))
    seen = df_p >= min(3, sizes[1])
    df_u = _counts(_frequencies(rows, seen))
    n_u = rows.count()
    prior = min(max(prior, 0.01), 0.5)
    kept = chosen(df_p, df_u, sizes[1], n_u, prior)
    sets = tables.write(_hashed(picked, kept)).toArrow()  # at most max_positive + max_unlabelled rows of 2 * FEATURES bytes
    label, folds = sets.column("label").to_numpy().astype(bool), sets.column("fold").to_numpy()
    places = [np.frombuffer(b.as_py(), np.uint16).astype(np.int64) for b in sets.column("places")]
    weights = tuned(places, label, folds, prior, len(kept))
    full = np.zeros(1 << BITS, np.float32)
    full[kept] = weights[:-1]
    return Model(full, float(weights[-1]))


def chosen(df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """The buckets that become features, sorted, from the numbers of texts that hold each.

    Unlabelled texts are toxic ones by the share ``prior``, so rates are compared with those of the clean
    texts among them: a word of toxic texts stands out whatever part of all rows they make up.
    """
    rate_p, rate_u = df_p / n_p, df_u / n_u
    rate_n = np.maximum(rate_u - prior * rate_p, 0) / (1 - prior)
    noise = (rate_u * (1 - rate_u) / n_u + 0.25 / n_u**2) / (1 - prior) ** 2
    spread = np.sqrt(rate_n * (1 - rate_n) / n_p + 0.25 / n_p**2 + noise)
    gain = np.where(df_p >= min(3, n_p), (rate_p - rate_n) / spread, 0)
    kept = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    return kept[gain[kept] >= GAIN]


def _matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate([np.zeros(0, np.int64), *sets]), len(sets)


def _margin(m, weights: np.ndarray) -> np.ndarray:
    return np.bincount(m[0], weights[m[1]], m[2]) + weights[-1]


def tuned(places: list[np.ndarray], label: np.ndarray, folds: np.ndarray, prior: float, size: int) -> np.ndarray:
    """Weights (and the bias) fitted to all rows with the settings whose risk on the rows of fold 0, not fitted to then, is least."""

    def parts(rows: np.ndarray):
        return [_matrix([places[k] for k in np.flatnonzero(rows & side)]) for side in (label, ~label)]

    inner, outer = parts(folds == 0), parts(folds != 0)
    best = (DECAYS[0], SLACKS[-1], STEPS[-1])
    if all(m[2] for m in (*inner, *outer)):
        risks = {(d, s, n): pu_risk(*inner, w, prior) for d in DECAYS for s in SLACKS for n, w in fit(*outer, prior, size, d, s).items()}
        best = min(risks, key=risks.get)
    return fit(*parts(np.ones(len(label), bool)), prior, size, *best[:2])[best[2]]


def pu_risk(p, u, weights: np.ndarray, prior: float) -> float:
    """The non-negative risk of positives ``p`` and unlabelled rows ``u``."""
    m_p, m_u = _margin(p, weights), _margin(u, weights)
    return float(prior * np.logaddexp(0, -m_p).mean() + max(0.0, np.logaddexp(0, m_u).mean() - prior * np.logaddexp(0, m_p).mean()))


def fit(p, u, prior: float, size: int, decay: float, slack: float) -> dict[int, np.ndarray]:
    """Weights after each number of ``STEPS``: full-batch Adam on the non-negative risk with logistic loss.

    ``p`` and ``u`` are matrices of positives and unlabelled rows.
    """
    n_p, n_u = p[2], u[2]
    weights = np.zeros(size + 1)
    weights[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(weights), np.zeros_like(weights)

    def back(m, g):
        return np.append(np.bincount(m[1], g[m[0]], size), g.sum())

    out = {}
    for step in range(1, max(STEPS) + 1):
        m_p, m_u = _margin(p, weights), _margin(u, weights)
        s_p, s_u = 1 / (1 + np.exp(-m_p)), 1 / (1 + np.exp(-m_u))
        risk_negative = np.logaddexp(0, m_u).mean() - prior * np.logaddexp(0, m_p).mean()
        g_negative = back(u, s_u / n_u) - back(p, prior * s_p / n_p)
        if risk_negative >= -slack * prior:
            g = back(p, prior * (s_p - 1) / n_p) + g_negative
        else:
            g = -g_negative
        g[:-1] += decay * weights[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step in STEPS:
            out[step] = weights.copy()
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row; null and empty texts get the score of the bias alone."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weights), model.weights[model.weights != 0], model.bias, model.bits))

    def run(batches):
        where, values, bias, bits = shared.value
        weights = np.zeros(1 << bits, np.float32)
        weights[where] = values
        local = Model(weights, bias, bits)
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(local.scores(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, score double")


def held_out():
    """The condition of documents that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on).

    A null id counts as not held out, cannot carry a label, and is scored like any other row.
    """
    model = train(docs, labels, ~held_out())
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    A null id goes by its own text's score; equal texts go or stay together.  An empty table gives no rows.
    """
    model = train(docs, labels, ~held_out())
    kind = docs.schema
    at = docs.columns.index("text")
    where, values, bias, bits = np.flatnonzero(model.weights), model.weights[model.weights != 0], model.bias, model.bits
    shared = docs.sparkSession.sparkContext.broadcast((where, values, bias, bits))

    def run(batches):
        where, values, bias, bits = shared.value
        weights = np.zeros(1 << bits, np.float32)
        weights[where] = values
        local = Model(weights, bias, bits)
        for batch in parts(batches):
            clean = local.scores(batch.column(at).to_pylist()) < THRESHOLD
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, kind)
