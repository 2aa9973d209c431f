"""Structured Streaming over observations: the same functions as in batch.

Everything before fusion is row-local and streams unchanged.  Fusion and redaction need an
observation's rows together, so whole observations are handled batch by batch.  The registry of
recent observations is kept state, bounded by ``n`` per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwright.functions import text
from veilwright.session import importable


def last_per_key(rows: DataFrame, key: str, *order: Column, n: int = 5) -> DataFrame:
    """The first ``n`` rows of each key in the order given (batch)."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def pair_with_latest(left: DataFrame, right: DataFrame, key: str, time: str, payload: str) -> DataFrame:
    """``left`` with ``latest``: the ``payload`` of the last ``right`` row of its key at or before its time (an as-of join)."""
    kind = right.schema[payload].dataType
    both = left.withColumns({"__side": F.lit(1), "__payload": F.lit(None).cast(kind)}).unionByName(right.select(key, time, F.lit(0).alias("__side"), F.col(payload).alias("__payload")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "__side", F.col("__payload").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("latest", F.last("__payload", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__payload")


def stream_hits(regions: DataFrame, strict: bool = False) -> DataFrame:
    """A stream of text hits from a stream of regions; stateless."""
    hits = regions.select("observation_id", "region_index", F.posexplode(F.expr(text.detect_sql("text", strict))).alias("k", "d"))
    return hits.select("observation_id", "region_index", "k", "d.*")


def windowed_counts(hits: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Hits by type and tumbling window of event time; rows later than ``late`` are left out."""
    return hits.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")


def handle_observations(pages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle`` (such as the batch engine) on every micro-batch of whole observations."""
    return pages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_last(rows: DataFrame, key: str, ident: str, time: str, n: int = 5) -> DataFrame:
    """A stream of (key, ident, time) kept as the ``n`` latest per key after each micro-batch; state holds ``n`` rows a key."""
    importable(rows.sparkSession)
    plain = rows.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("long").alias("ident"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))

    def update(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            held += list(zip(frame["at"].tolist(), frame["ident"].tolist()))
            held = sorted(held, reverse=True)[:n]
        state.update(([at for at, _ in held], [i for _, i in held]))
        yield pd.DataFrame({"key": [name[0]] * len(held), "ident": [i for _, i in held], "at": [at for at, _ in held]})

    return plain.groupBy("key").applyInPandasWithState(update, "key string, ident long, at long", "at array<long>, ident array<long>", "update", "NoTimeout")
