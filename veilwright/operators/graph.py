"""Small graphs inside observations: one row-local call per observation that has links at all."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Forest:
    """Disjoint sets over any hashable nodes; a set's root is its smallest member."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        path = []
        while (up := self.above.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for node in path:
            self.above[node] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True


def per_observation(links: DataFrame, call: Callable[[list[dict]], list[tuple[int, ...]]], values: tuple[str, ...] = ("value",)) -> DataFrame:
    """(observation_id, det_ord, values) from ``call`` on the list of each observation's link rows, ordered by (i, j)."""
    columns = ["i", "j"] + [c for c in links.columns if c not in ("observation_id", "i", "j")]
    packed = links.groupBy("observation_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("links"))

    def run(batches):
        for batch in batches:
            rows = [(o, *found) for o, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for found in call(links)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k else pa.string()) for k in range(2 + len(values))], ["observation_id", "det_ord", *values])

    return packed.mapInArrow(run, "observation_id string, det_ord int, " + ", ".join(f"{v} int" for v in values))


def breadth_first(links: list[dict]) -> list[tuple[int, int, int]]:
    """(node, smallest node of its component, rank) in the order of breadth-first visits from each component's smallest node."""
    near: dict[int, set[int]] = {}
    for link in links:
        near.setdefault(link["i"], set()).add(link["j"])
        near.setdefault(link["j"], set()).add(link["i"])
    seen: set[int] = set()
    out = []
    for start in sorted(near):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        for x in queue:
            fresh = sorted(near[x] - seen)
            seen.update(fresh)
            queue += fresh
        out += [(x, start, rank) for rank, x in enumerate(queue)]
    return out
