"""Connected components of an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwright.llm.common import Tables


def connected_components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: comparable ids); component is its smallest node.

    Each round maps every edge set to one of at most the same size that connects the same nodes,
    until every component is a star around its smallest node.  Rounds are written tables; only a
    count and a checksum of them reach the driver.  Self-loops are ignored; no edges, no rows.
    """
    forward = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = tables.write(forward)
    before = None
    while True:
        for larger in (True, False):
            after = _star(current, tables, larger)
            tables.drop(current)
            current = after
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = current.groupBy("v").count().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _star(edges: DataFrame, tables: Tables, larger: bool) -> DataFrame:
    """Edges (u > v) after linking each node's larger (or smaller) neighbours to its smallest one.

    The smallest neighbours are written first: then both sides of the join come straight from
    their exchanges, and adaptive execution may split the edges of a hub over many tasks.
    """
    if larger:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        near = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = tables.write(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    joined = near.join(least.hint("merge"), "a")
    if larger:
        linked = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    out = tables.write(linked.where("u <> v").distinct())
    tables.drop(least)
    return out
