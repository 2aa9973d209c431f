"""Exact de-duplication by distributed most-significant-digit radix partitioning.

A digit is a block of successive bytes of the UTF-8 text.  Every round splits each group of
documents that share all earlier bytes by their next digit; a group is finished when one
document is left in it (a singleton, never touched again) or when its texts have ended (its
members are equal).  Digits widen from round to round, so the number of rounds grows with the
logarithm of the longest text.  No digest takes part in deciding equality.

Scale: the first digit is read without moving texts; only documents whose first digit is shared
have their remaining bytes carried along.  A round costs one pre-aggregated ``groupBy`` over
(group, digit) and one equi-join back, in which adaptive execution may split a hot group, since
nothing above the join needs its rows together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import Tables, id_and_text, id_bytes, small_side

FIRST_DIGIT = 128
WIDEN = 8


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other.  The largest doc_id of a
    group stays.  Repeated rows (same id and text) count one by one in group_size and share
    their flags.  A null id never wins over another id.  An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "exact-dedup")
    base = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    body = F.col("text").cast("binary")
    sha = F.sha2(body, 256)

    finished = []
    digit = F.substring(body, 1, first_digit)
    groups = tables.write(_shared(base.select("doc_id", F.lit(0).cast("long").alias("gid"), digit.alias("digit"))))
    heads = base.select("doc_id", sha.alias("sha"), digit.alias("digit"), F.length(body).alias("n"))
    members = tables.write(_rejoin(heads.withColumn("gid", F.lit(0).cast("long")), groups).select("doc_id", "sha", "new_gid", "keep_id", "group_size", (F.col("n") < first_digit).alias("ended")))
    finished.append(members.where("ended"))
    open_ids = members.where("not ended").select("doc_id", "sha", F.col("new_gid").alias("gid"))
    n_open = open_ids.count()
    width, done = first_digit * widen, first_digit
    if n_open:
        # a repeated (id, text) row appears once here and once in the texts, so ids are made distinct
        ids = open_ids.dropDuplicates(["doc_id", "sha"])
        texts = base.select("doc_id", body.alias("body"), sha.alias("sha"))
        hit = small_side(ids.select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), "gid"), n_open, id_bytes(ids, "doc_id", 64 + 24))
        active = tables.write(texts.join(hit, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s"))).select("doc_id", "sha", "gid", F.expr(f"substring(body, {done + 1})").alias("rest")))
        while True:
            digit = F.substring("rest", 1, width)
            cut = active.withColumn("digit", digit)
            groups = tables.write(_shared(cut.select("doc_id", "gid", "digit")))
            split = tables.write(_rejoin(cut, groups).select("doc_id", "sha", "new_gid", "keep_id", "group_size", (F.length("rest") < width).alias("ended"), F.expr(f"case when length(rest) >= {width} then substring(rest, {width + 1}) end").alias("rest")))
            tables.drop(groups, active)
            finished.append(split.where("ended"))
            active = split.where("not ended").select("doc_id", "sha", F.col("new_gid").alias("gid"), "rest")
            if active.isEmpty():
                break
            active = tables.write(active)
            width *= widen
    columns = ["doc_id", "sha", "keep_id", "group_size"]
    classes = finished[0].select(columns)
    for part in finished[1:]:
        classes = classes.union(part.select(columns))
    classes = classes.dropDuplicates(["doc_id", "sha"]).select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), "keep_id", "group_size")
    rows = base.select("doc_id", sha.alias("text_sha256"))
    out = rows.join(classes, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("s")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Digits that at least two documents of a group share, numbered; written, so the numbers are fixed."""
    counted = rows.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    return counted.where("group_size > 1").withColumn("new_gid", F.monotonically_increasing_id())


def _rejoin(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(groups.hint("merge"), ["gid", "digit"])


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows of one id and text one stays."""
    verdict = exact_dedup(docs).where("not kept").select("doc_id", "text_sha256").distinct()
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    key = verdict.select(F.col("doc_id").alias("__i"), F.col("text_sha256").alias("__s"))
    left = docs.join(key, F.col("doc_id").eqNullSafe(F.col("__i")) & (sha == F.col("__s")), "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
