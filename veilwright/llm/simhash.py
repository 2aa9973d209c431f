"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r, every bit position i gets a vector phi(i) of r+1 bits, and each of the 2^(r+1)-1
non-zero vectors v gives a mask of the positions with <phi(i), v> = 1.  Two fingerprints that
differ in at most r positions leave some v orthogonal to all of those positions' vectors, so they
agree under that mask: no pair within the radius is ever missed, for any choice of phi.

Scale: texts are hashed where they are read; only (id, 64-bit fingerprint) rows move.  Equal
fingerprints become one node first, so groups of copies cost one row.  Buckets (mask, masked
value) are counted with map-side partial sums; almost all hold one fingerprint and end there, a
bucket of two yields its pair from the counts alone.  A bucket within ``BUCKET`` is linked by a
spanning forest (at most its size minus one links, never all pairs).  A larger bucket is cut by
the same family over the bits that are still free, which again loses no pair; as the free bits
shrink by half each time and a bucket of b free bits has at most 2^b fingerprints, the cutting
ends with at most 2^``FREE`` of them.  Components are found with distributed star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import Tables, id_and_text, id_bytes, parts, small_side
from veilwright.llm.components import connected_components

WORDS = 4
SEED = 42
RADIUS = 4
BUCKET = 512
FREE = 9


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned SimHash of a text: ASCII-lower-cased, white-space words, shingles of ``words`` words.

    Fewer words than that make one shingle; none at all (null, empty, blank) gives zero.
    """
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = len(parts)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], np.uint64)
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row per input row."""
    rows = id_and_text(docs, id_col, text_col)

    def hashed(batches):
        for batch in parts(batches):
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(hashed, f"doc_id {rows.schema[0].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the covering family, as unsigned integers; every mask holds about half of the bits."""
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % size + 1) & v).count("1") % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) that connect exactly what the pairs within ``radius`` connect: a breadth-first forest."""
    free = np.ones(len(fps), bool)
    links = []
    for root in range(len(fps)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(free)
            near = rest[np.bitwise_count((fps[rest] ^ fps[at]).view(np.uint64)) <= radius]
            free[near] = False
            links += [(at, k) for k in near.tolist()]
            queue += near.tolist()
    return links


def _link_buckets(radius: int):
    def linked(batches):
        held: list[np.ndarray] = []
        key = None

        def forest() -> list[tuple[int, int]]:
            fps = np.concatenate(held)
            return [(int(fps[x]), int(fps[y])) for x, y in _forest(fps, radius)]

        for batch in batches:
            mask, value, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            links: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
                now = (int(mask[a]), int(value[a]))
                if now != key and held:
                    links += forest()
                    held = []
                key = now
                held.append(fp[a:b])
            yield _links(links)
        if held:
            yield _links(forest())

    return linked


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])


def near_links(nodes: DataFrame, tables: Tables, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between fingerprints whose closure is that of all pairs of ``nodes.fp`` (distinct) within ``radius``."""
    masks = [_signed(m) for m in covering_masks(radius)]
    family = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    rows = nodes.select("fp", family.alias("mask"))
    links, level = [], 0
    while True:
        level += 1
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        counted = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        shared = tables.write(counted.where("n > 1"))
        links.append(shared.where(f"n = 2 and bit_count(u ^ v) <= {radius}").select("u", "v"))
        # with few bits left free a bucket has at most 2 ** FREE fingerprints, however they are spread
        large_sql = f"(n > {bucket} and bit_count(~mask) > {FREE})"
        sizes = shared.agg(F.count(F.when(F.expr(f"n > 2 and not {large_sql}"), 1)), F.count(F.when(F.expr(large_sql), 1))).first()
        if sizes[0]:
            keys = small_side(shared.where(f"n > 2 and not {large_sql}").select("mask", "value"), sizes[0])
            members = rows.join(keys, ["mask", "value"]).select("mask", "value", "fp")
            dealt = members.repartition("mask", "value").sortWithinPartitions("mask", "value")
            links.append(tables.write(dealt.mapInArrow(_link_buckets(radius), "u long, v long").distinct()))
        if not sizes[1]:
            break
        keys = small_side(shared.where(large_sql).select("mask", "value"), sizes[1])
        large = rows.join(keys, ["mask", "value"]).select("fp", F.col("mask").alias("outer_mask"))
        cut = large.select("fp", "outer_mask", family_column(masks, level).alias("inner_mask"))
        rows = tables.write(cut.select("fp", F.col("outer_mask").bitwiseOR(F.col("inner_mask")).alias("mask")).distinct())
    out = links[0]
    for part in links[1:]:
        out = out.union(part)
    return out.distinct()


def family_column(masks: list[int], level: int):
    """The masks again for a deeper level, rotated so that they halve the bits left free by the levels above."""
    turned = [_signed(((m & (2**64 - 1)) << s | (m & (2**64 - 1)) >> (64 - s)) & (2**64 - 1)) for m in masks for s in [7 * level % 64]]
    return F.explode(F.array(*[F.lit(m).cast("long") for m in turned]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id).

    Ids are of any ordered type: links join fingerprints, and ids only come in at the end.  Null,
    empty and blank texts have fingerprint zero and are linked like any other.  Repeated rows share
    their class.  A row without id gets its class's id, which is null only if no row of the class has
    one.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "simhash")
    hashed = tables.write(fingerprints(docs, id_col, text_col, words))
    nodes = tables.write(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = tables.write(near_links(nodes, tables, radius, bucket))
    count = links.count()
    classes = connected_components(links, tables).select(F.col("node").alias("fp"), F.col("component"))
    known = tables.write(nodes.join(small_side(classes, 2 * count), "fp", "left"))
    ids = known.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    labels = known.join(small_side(ids, 2 * count, id_bytes(ids, "component_id")), "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    joined = hashed.join(labels.hint("merge"), "fp", "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their near-duplicate class, with all their columns.

    Rows without id stay, and so do all rows that repeat a kept id and text.  Where one id has
    several texts, each text goes or stays by its own class.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "one-of-each")
    found = tables.write(near_duplicates(docs).where("doc_id is not null"))
    goes = F.col("doc_id") != F.col("component_id")
    verdict = tables.write(found.groupBy("doc_id").agg(F.max(goes).alias("some"), F.min(goes).alias("all")).where("some"))
    left = docs.join(verdict.where("all").select("doc_id").hint("merge"), "doc_id", "left_anti")
    mixed = verdict.where("not all").select("doc_id")
    if mixed.isEmpty():
        return left.select(*[f"`{c}`" for c in docs.columns])
    # only the texts of such ids are hashed again
    out = found.join(mixed.hint("merge"), "doc_id").where(goes).select("doc_id", "fingerprint").distinct()
    own = left.join(mixed.hint("merge"), "doc_id", "left_semi").withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    hashed = fingerprints(own.dropDuplicates(["__sha"]), "__sha").select(F.col("doc_id").alias("__sha"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("__fp"))
    marked = own.join(hashed, "__sha")
    gone = out.select(F.col("doc_id").alias("__i"), F.col("fingerprint").alias("__f"))
    kept = marked.join(gone, (F.col("doc_id") == F.col("__i")) & (F.col("__fp") == F.col("__f")), "left_anti")
    columns = [f"`{c}`" for c in docs.columns]
    return left.join(mixed.hint("merge"), "doc_id", "left_anti").select(*columns).union(kept.select(*columns))
