"""BPE encoding and decoding through a table of distinct words.

Texts are split into words (the pre-tokens of the tokenizer), slice by slice: a slice is some
texts of one task with about ``SLICE_CHARS`` characters.  A slice writes each of its distinct words
once, packed by hash bucket, and for every text the positions' places in that dictionary.  A bucket
then holds all slices' words of its hash range; there each distinct word is encoded once, and the ids
go back to the slices.  Joined by slice, every position gets its word's ids, and decoding joins each
text's ids with the id-to-piece table, a whole slice at a time.

Scale: no table of all words exists anywhere, on the driver or in a worker.  A word moves once a slice
however often it occurs, so a frequent word is no hot key; buckets grow in number with the corpus
(``BUCKET_CHARS``) and slices are of one size, so every group is bounded (a text longer than a slice is
one).  The split is written once, bucketed by slice, so its positions are not shuffled; shuffles carry the
words and their ids in packed, compressed rows.  The id-to-piece table has
the vocabulary's size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import Tables, id_and_text, write_bucketed

SLICE_CHARS = 16 << 20
BUCKET_CHARS = 64 << 20
BUCKETS = 64
_PACK = pa.Codec("zstd", 1)

#: Characters below this point have the same classes in every Unicode version at hand.
_STABLE = 0x530
_OTHER = re.compile("[^\\u0000-\\u052f\\u2000-\\u206f]")


def _classes(kind: str) -> str:
    points = [p for p in range(_STABLE) if unicodedata.category(chr(p))[0] == kind]
    return "".join(f"\\u{p:04x}" for p in points)


def _pattern() -> re.Pattern:
    letters, digits = _classes("L"), _classes("N")
    space = "\\t-\\r \\u0085\\u00a0\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class Coder:
    """One tokenizer file: words of texts, ids of words, pieces of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = self._alphabet()
        self.pieces: list[bytes] = [b""] * (max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1)
        for token, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self._from_alphabet = alphabet
        self._fast = _pattern()
        self._model = spec["model"]

    @cached_property
    def _ranked(self):
        """Made on first use: only ``ids`` needs it."""
        return self._by_rank(self.__dict__.pop("_model"))

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable character that byte-level vocabularies use for each byte, to that byte."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def _by_rank(self, model: dict):
        """A rank-based encoder of the same merges, if the ids follow the order of the merges; else None."""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = {self.pieces[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("same-merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str) -> list[str]:
        return [p for p in self._cut.split(text) if p] if self._cut and "<|" in text else [text] if text else []

    def words(self, text: str | None) -> list[str]:
        """The text's pre-tokens in order, special tokens apart; joined they are the text."""
        out: list[str] = []
        for part in self._parts(text or ""):
            if part in self.special:
                out.append(part)
            elif _OTHER.search(part):
                split = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                out += [bytes(map(self._from_alphabet.__getitem__, w)).decode() for w, _ in split]
            else:
                out += self._fast.findall(part)
        return out

    def ids(self, text: str | None) -> list[int]:
        """What the tokenizer gives for a text, by rank where that is the same thing."""
        out: list[int] = []
        for part in self._parts(text or ""):
            if self._ranked and part not in self.special and not _OTHER.search(part):
                out += self._ranked.encode_ordinary(part)
            else:
                out += self.tokenizer.encode(part, add_special_tokens=False).ids
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, without building the tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + _PACK.compress(data, asbytes=True)


def _unpacked(data: bytes) -> memoryview:
    return memoryview(_PACK.decompress(data[4:], int.from_bytes(data[:4], "little")))


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as one compressed block, byte by byte: all lowest bytes first."""
    return _packed(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """The words' lengths in bytes and their bytes, as two compressed blocks."""
    raw = [w.encode() for w in words]
    return pack_numbers(np.array([len(w) for w in raw], np.uint32)), _packed(b"".join(raw))


def unpack_words(lengths: bytes, data: bytes) -> list[str]:
    ends = np.cumsum(unpack_numbers(lengths), dtype=np.int64).tolist()
    raw = bytes(_unpacked(data))
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all runs (start, length) one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


# ------------------------------------------------------------------------- split, encode, join, decode

#: Columns of the written split.  Kind 0 is a slice: its texts' ids and numbers of words, the places of all their
#: words in the slice's dictionary (common words first), and the bucket of each dictionary word.  Kind 1 is a bucket
#: of a slice's dictionary: its words' lengths and bytes, in the dictionary's order.
_SPLIT = ("kind", "slice", "bucket", "ids", "lengths", "packed", "buckets")


def split_words(rows: DataFrame, path: str, buckets: int, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """The texts' words, slice by slice; see ``_SPLIT``."""

    def run(batches):
        c = coder(path)
        first = TaskContext.get().partitionId() << 32
        number, size = 0, 0
        seen: dict[str, int] = {}
        ids: list = []
        held: list[np.ndarray] = []

        def close():
            words, at = list(seen), np.concatenate(held)
            times = np.bincount(at, minlength=len(words))
            order = sorted(range(len(words)), key=lambda k: (-times[k], words[k]))
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            words = [words[k] for k in order]
            bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words], np.int64)
            lengths = np.array([len(x) for x in held], np.uint32)
            rows = [(0, first + number, None, ids, pack_numbers(lengths), pack_numbers(place[at]), pack_numbers(bucket))]
            by_bucket = np.argsort(bucket, kind="stable")
            for part in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if len(words) else []:
                own = part.tolist()
                rows.append((1, first + number, int(bucket[own[0]]), None, *pack_words([words[k] for k in own]), None))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _SPLIT)

        for batch in batches:
            id_type = batch.column(0).type
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                ids.append(batch.column(0)[k].as_py())
                held.append(np.array([seen.setdefault(w, len(seen)) for w in c.words(text)], np.uint32))
                size += len(text or "") + 1
                if size >= slice_chars:
                    yield close()
                    number, size, seen, ids, held = number + 1, 0, {}, [], []
        if held:
            yield close()

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"kind int, slice long, bucket long, ids array<{kind}>, lengths binary, packed binary, buckets binary")


def encode_buckets(split: DataFrame, path: str) -> DataFrame:
    """slice, bucket, counts, ids: the ids of each slice's words of a bucket; in a bucket every distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        c = coder(path)
        known: dict[str, int] = {}
        counts, ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        out = []
        for block in zip(table.column("lengths").to_pylist(), table.column("packed").to_pylist()):
            words, before = unpack_words(*block), len(known)
            at = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            if len(known) > before:
                coded = c.encode_words([w for w, k in zip(words, at.tolist()) if k >= before])
                counts = np.append(counts, [len(x) for x in coded])
                ids = np.append(ids, np.fromiter((i for x in coded for i in x), np.uint32))
            starts = np.cumsum(counts) - counts
            out.append((pack_numbers(counts[at]), pack_numbers(ids[gather(starts[at], counts[at])])))
        return pa.Table.from_arrays([table.column("slice"), table.column("bucket"), *(pa.array([r[k] for r in out], pa.binary()) for k in (0, 1))], ["slice", "bucket", "counts", "ids"])

    words = split.where("kind = 1").select("slice", "bucket", "lengths", "packed")
    return words.groupBy("bucket").applyInArrow(run, "slice long, bucket long, counts binary, ids binary")


class Pieces:
    """The id-to-piece table in columns: for each id its decoded bytes, and its decimal form with a comma."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pa.array(pieces, pa.binary())
        self.decimals = pa.array([b"%d," % k for k in range(len(pieces))], pa.binary())

    @staticmethod
    def joined(column: pa.Array, ids: np.ndarray) -> memoryview:
        """The column's values of the ids, one after another."""
        found = column.take(pa.array(ids))
        end = np.frombuffer(found.buffers()[1], np.int32)[len(ids)] if len(ids) else 0
        return memoryview(found.buffers()[2] or b"")[: int(end)]


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(coder(path).pieces)


def assemble(split: DataFrame, coded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: words' ids joined back by slice and position, pieces joined by id."""
    kind = split.schema["ids"].dataType.elementType.simpleString()

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        table, out = _pieces(path), []
        id_type = texts.schema.field("ids").type.value_type
        names = []
        words = words.sort_by("bucket")
        by_bucket = [np.concatenate([np.zeros(0, np.uint32), *map(unpack_numbers, words.column(c).to_pylist())]) for c in ("counts", "ids")]
        for row in texts.to_pylist():  # one slice
            order = np.argsort(unpack_numbers(row["buckets"]), kind="stable")
            counts, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            counts[order] = by_bucket[0]
            starts[order] = np.cumsum(by_bucket[0], dtype=np.int64) - by_bucket[0]
            places, begin = unpack_numbers(row["packed"]), 0
            names += row["ids"]
            for n in unpack_numbers(row["lengths"]).tolist():
                at = places[begin : begin + n]
                begin += n
                own = by_bucket[1][gather(starts[at], counts[at])]
                decimal, decoded = table.joined(table.decimals, own), table.joined(table.pieces, own)
                text = bytes(decoded).decode("utf-8", "replace")
                out.append((len(own), hashlib.sha256(decimal[:-1]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.Table.from_arrays([pa.array(names, id_type), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = split.where("kind = 0").select("slice", "ids", "lengths", "packed", "buckets")
    return texts.groupBy("slice").cogroup(coded.groupBy("slice")).applyInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, digests of the ids and of the decoded text.

    Null counts as empty: no tokens, digests of the empty string.  Repeated rows each give their
    row; a null id is carried.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "bpe")
    rows = id_and_text(docs, id_col, text_col)
    chars = rows.select(F.sum(F.length("text"))).first()[0] or 0
    words = split_words(rows, path, max(BUCKETS, -(-chars // bucket_chars)), slice_chars)
    split = write_bucketed(tables, words, "slice", max(1, -(-2 * chars // slice_chars)))
    return assemble(split, encode_buckets(split, path), path)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and text of rows of token ids: positions joined with the id-to-piece table, pieces joined in order.

    Null ids give a null text; null elements and ids outside the vocabulary give an empty piece.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        table = _pieces(path)
        n = len(table.pieces)
        for batch in batches:
            texts = []
            for x in batch.column(1).to_pylist():
                own = np.array([i for i in x or [] if i is not None and 0 <= i < n], np.int64)
                texts.append(None if x is None else bytes(table.joined(table.pieces, own)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
