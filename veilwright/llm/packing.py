"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window.

Each document's ids (then the separator id) are cut into full windows, which need no
neighbours, and a tail.  The index is sharded by lexical content: documents are put in the order of a
min-hash signature of their runs of three ids, so that documents that share text stand together, and
each task cuts its range of that order into shards of ``SHARD`` rows.  A shard indexes the whole documents
of its tails and scores them for all terms of the seed's whole document, with document frequencies
counted over all documents.  Windows are filled greedily: the longest unused tail is the seed, the
highest scoring unused neighbours that fit follow, however low their rank, and the best one left is
cut to fill the rest, its remainder staying in the index.  So only the last window of a shard is padded.

A seed is scored against its own shard, not against all others; how many of its best neighbours that
keeps is measured (recall: README).

Scale: one pass writes windows' checksums, tails, signatures and per-task term counts; terms are token
ids, so counts have at most the vocabulary's size and are the only thing sent to the driver.  Rows are
shuffled once, by ranges of the order.  Ranges end in a row number, so that any number of equal
texts, or of repeated rows, is split evenly; a worker holds one shard at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.bpe import coder, vocabulary_size
from veilwright.llm.common import Tables, id_and_text, mix

WINDOW = 1024
SEPARATOR = 0
SHARD = 512
BATCH = 256
K1, B = 1.2, 0.75
SIGNATURE = 4
PARTITION_BYTES = 32 << 20


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def signature(ids: np.ndarray) -> tuple[int, ...]:
    """The ``SIGNATURE`` smallest hashes of the runs of three ids (of the whole, if shorter), ascending, as longs; filled up with the last."""
    wide = ids.astype(np.uint64)
    runs = wide[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + wide[1:-1] * np.uint64(0x165667B19E3779F9) + wide[2:] if len(wide) > 2 else wide[:1] + np.uint64(len(wide) << 32)
    h = mix(runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    least = np.sort(np.partition(h, SIGNATURE - 1)[:SIGNATURE] if len(h) > SIGNATURE else h).tolist()
    return tuple(least + least[-1:] * (SIGNATURE - len(least)))


def tokenized(docs: DataFrame, path: str, tables: Tables, window: int = WINDOW) -> DataFrame:
    """Written rows: kind 0 for documents, kind 1 for a task's document frequencies (in ``tail``).

    Documents: number (of the row, unique), s0 and so on (signature), full windows' checksums, tail ids,
    all terms and their counts if the tail is not all.
    """
    id_kind = docs.schema[0].dataType.simpleString()
    signatures = [f"s{k}" for k in range(SIGNATURE)]
    names = ["kind", "doc_id", "number", *signatures, "doc_tokens", "crcs", "tail", "terms", "counts"]
    kinds = [pa.int32(), None, *[pa.int64()] * (SIGNATURE + 2), pa.list_(pa.int64()), *[pa.binary()] * 3]

    def run(batches):
        c = coder(path)
        df, number = np.zeros(len(c.pieces), np.uint32), TaskContext.get().partitionId() << 32
        first, id_type = number, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t or id_type) for k, t in enumerate(kinds)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for begin in range(0, batch.num_rows, BATCH):
                part, rows = batch.slice(begin, BATCH), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*c.ids(text), SEPARATOR], np.uint32)
                    held, times = np.unique(ids, return_counts=True)
                    df[held] += 1
                    cut = len(ids) // window * window
                    crcs = [_crc(ids[k : k + window]) for k in range(0, cut, window)]
                    whole = (held.tobytes(), times.astype(np.uint32).tobytes()) if cut else (b"", b"")
                    rows.append((0, doc, number, *signature(ids), len(ids), crcs, ids[cut:].tobytes(), *whole))
                    number += 1
                yield batch_of(rows)
        if number > first:
            yield batch_of([(1, None, first, *[0] * SIGNATURE, 0, [], df.tobytes(), b"", b"")])

    longs = ", ".join(f"{x} long" for x in ("number", *signatures, "doc_tokens"))
    return tables.write(docs.mapInArrow(run, f"kind int, doc_id {id_kind}, {longs}, crcs array<long>, tail binary, terms binary, counts binary"))


def _frequencies(rows: DataFrame, n_terms: int) -> np.ndarray:
    """Documents holding each term, over all documents: summed in tasks, then by term."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.uint32)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "n"])

    counted = rows.where("kind = 1").select("tail").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n_terms, np.int64)
    for term, n in counted.collect():  # at most one row for each id of the vocabulary
        out[term] = n
    return out


class Shard:
    """The index of some tails' whole documents and the greedy filling of windows from the tails.

    ``whole`` has each document's terms and their counts; without it the tails are the documents.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float, window: int = WINDOW, whole: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.tails, self.window = tails, window
        n = len(tails)
        whole = whole or [np.unique(t, return_counts=True) for t in tails]
        sizes = np.array([c.sum() for _, c in whole], np.int64)
        docs = np.repeat(np.arange(n), [len(t) for t, _ in whole])
        terms = np.concatenate([*(t for t, _ in whole), np.zeros(0, np.uint32)]).astype(np.int64)
        tf = np.concatenate([*(c for _, c in whole), np.zeros(0, np.int64)])
        held = np.bincount(terms, minlength=len(idf))
        shared = np.flatnonzero(held > 1)  # a term of one document cannot tell others apart
        at = np.full(len(held), -1, np.int64)
        at[shared] = np.arange(len(shared))
        norm = K1 * (1 - B + B * sizes / max(average, 1e-9))
        keep = at[terms] >= 0
        docs, terms, tf = docs[keep], terms[keep], tf[keep]
        self.weights = np.zeros((len(shared), n), np.float32)
        self.weights[at[terms], docs] = idf[terms] * tf * (K1 + 1) / (tf + norm[docs])
        self.rows = [at[t][at[t] >= 0] for t, _ in whole]
        self.left = np.array([len(t) for t in tails], np.int64)
        self.from_at = np.zeros(n, np.int64)

    def neighbours(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of the seed's document that another one of the shard has."""
        return self.weights[self.rows[seed]].sum(axis=0)

    def windows(self):
        """Lists of (tail, start in it, length); each id of each tail is in exactly one."""
        for seed in np.argsort(-self.left, kind="stable").tolist():
            if not self.left[seed]:
                continue
            room = self.window
            out = []

            def take(k: int, most: int) -> int:
                n = min(int(self.left[k]), most)
                out.append((k, int(self.from_at[k]), n))
                self.from_at[k] += n
                self.left[k] -= n
                return n

            room -= take(seed, room)
            if room:
                open_ = np.flatnonzero(self.left)
                if len(open_):
                    scores = self.neighbours(seed)[open_]
                    ranked = open_[np.argsort(-scores, kind="stable")].tolist()
                    for k, length in zip(ranked, self.left[ranked].tolist()):
                        if not room:
                            break
                        if length <= room:
                            room -= take(k, room)
                    for k in ranked:
                        if not room:
                            break
                        if self.left[k]:
                            room -= take(k, room)
            yield out


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _filled(rows: list[dict], idf: np.ndarray, average: float, window: int, sequence: int) -> tuple[list[tuple], int]:
    """Pieces (doc_id, then ``_PIECE``) of a shard's documents, and the next sequence's number."""
    tails = [np.frombuffer(r["tail"], np.uint32) for r in rows]
    whole = [tuple(np.frombuffer(r[c], np.uint32) for c in ("terms", "counts")) if r["terms"] else np.unique(t, return_counts=True) for r, t in zip(rows, tails)]
    out = []
    for r in rows:
        for w, crc in enumerate(r["crcs"]):
            out.append((r["doc_id"], w * window, window, crc, r["doc_tokens"], sequence, 0))
            sequence += 1
    for found in Shard(tails, idf, average, window, whole).windows():
        offset = 0
        for k, a, length in found:
            total = rows[k]["doc_tokens"]
            out.append((rows[k]["doc_id"], total - len(tails[k]) + a, length, _crc(tails[k][a : a + length]), total, sequence, offset))
            offset += length
        sequence += 1
    return out, sequence


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one separator id.  Every input row is packed, repeated rows and rows without
    an id too.  Sequences hold at most ``window`` ids; one in each shard may be shorter.  Equal scores go
    by the order of the signatures.  Empty table, no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "packing")
    rows = tokenized(id_and_text(docs, id_col, text_col), path, tables, window)
    pieces = rows.where("kind = 0").drop("kind")
    n, total = pieces.agg(F.count(F.lit(1)), F.sum("doc_tokens")).first()
    n_terms = vocabulary_size(path)
    df = _frequencies(rows, n_terms)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).clip(min=0).astype(np.float32)
    average = (total or 0) / max(n, 1)
    shared = spark.sparkContext.broadcast(idf)
    id_kind = rows.schema["doc_id"].dataType.simpleString()

    def fill(batches):
        held: list[pa.RecordBatch] = []
        sequence, left = TaskContext.get().partitionId() << 32, 0

        def shards(last: bool):
            nonlocal held, left, sequence
            table = pa.Table.from_batches(held)
            cut = left if last else left // shard * shard
            for begin in range(0, cut, shard):
                out, sequence = _filled(table.slice(begin, min(shard, cut - begin)).to_pylist(), shared.value, average, window, sequence)
                columns = [pa.array([x[k] for x in out], pa.int64() if k else table.schema.field("doc_id").type) for k in range(1 + len(_PIECE))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_PIECE])
            held = table.slice(cut).to_batches()
            left -= cut

        for batch in batches:
            held.append(batch)
            left += batch.num_rows
            if left >= shard:
                yield from shards(False)
        if left:
            yield from shards(True)

    least = min(spark.sparkContext.defaultParallelism, -(-n // shard))
    order = [*(f"s{k}" for k in range(SIGNATURE)), "number"]
    ranges = pieces.repartitionByRange(max(1, least, -(-4 * (total or 0) // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    return ranges.mapInArrow(fill, f"doc_id {id_kind}, " + ", ".join(f"{c} long" for c in _PIECE))
