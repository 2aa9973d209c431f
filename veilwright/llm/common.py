"""Shared helpers of the training-data operators: reading documents, sized joins, byte hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwright.session import importable
from veilwright.stages import Tables

__all__ = ["ALPHANUMERIC", "NOT_SPACE", "Tables", "Words", "documents", "id_and_text", "id_bytes", "mix", "parts", "slices", "small_side", "write_bucketed"]

#: A join side may be broadcast only while its counted rows take at most so many bytes.
BROADCAST_BYTES = 24 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names, so that other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def small_side(df: DataFrame, rows: int, row_bytes: int | None = 16) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows of at most ``row_bytes`` keep within the bound, else (or if None) with a merge-join hint."""
    fits = row_bytes is not None and rows * row_bytes <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df.hint("merge")


def id_bytes(df: DataFrame, column: str, rest: int = 16) -> int | None:
    """The most bytes of a row with an id and ``rest`` more; None if ids have no fixed length."""
    return rest + 8 if df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long", "date", "timestamp") else None


def write_bucketed(tables: Tables, df: DataFrame, column: str, buckets: int) -> DataFrame:
    """``df`` written below the shared folder in hash buckets of ``column``; joins and groups by it need not move these rows again."""
    name = f"veilwright_{uuid.uuid4().hex}"
    tables.n += 1
    atexit.register(_forget, tables.spark, name)
    df.write.format("parquet").bucketBy(buckets, column).option("path", f"{tables.root}/{tables.n}").saveAsTable(name)
    return tables.spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# --------------------------------------------------------------------- hashing of words in numpy

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of words: all but white space; or letters, digits and everything outside ASCII.
NOT_SPACE = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
ALPHANUMERIC = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_FACTOR, _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """Positions and rolling hashes of the words of some texts (lower-cased), without a loop over words."""

    def __init__(self, texts: list[str | None], word_bytes: np.ndarray):
        blobs = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        lengths = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
        data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        inside = word_bytes[data].astype(np.int8)
        steps = np.diff(inside, prepend=np.int8(0))
        self.starts = np.flatnonzero(steps == 1)
        self.ends = np.flatnonzero(steps == -1)
        powers, self._inverse = _power_tables(max(1 << 16, 1 << int(len(data)).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
        self._sums = sums
        self.docs = np.searchsorted(np.cumsum(lengths), self.starts, "right")
        self.n_docs = len(blobs)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return (self._sums[ends] - self._sums[self.starts]) * self._inverse[self.starts]


def parts(batches, rows: int = 512):
    """The Arrow batches in pieces of at most ``rows`` rows, so that few texts at a time become Python strings."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def slices(texts: list[str | None], most: int = 1 << 20):
    """Ranges of ``texts`` with about ``most`` characters each, so that working memory stays bounded."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
