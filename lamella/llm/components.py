"""Connected components of a distributed edge list, by alternating large-star and small-star rounds.

Each round first contracts what meets in a task: a bounded run of edges becomes
stars around its own components' smallest nodes. That changes no component, and
a list that fits one run is solved by it, as soon as the rounds have made it that short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .text import released

#: Nodes that a task's contraction holds at once, at about 200 bytes each.
RUN_NODES = 400_000


def _stars(up: dict[int, int], root) -> pa.RecordBatch:
    u = np.fromiter(up, np.int64, len(up))
    v = np.fromiter((root(x) for x in up), np.int64, len(up))
    return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])


@released
def _contract(batches):
    """Edges (u, v), v smaller, with the same components: each run's nodes beside the smallest of theirs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (above := up.setdefault(top, top)) != top:
            top = above
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) >= RUN_NODES:
            yield _stars(up, root)
            up.clear()
    if up:
        yield _stars(up, root)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(store: Store, edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) names; component is the smallest node reachable.

    Each round aggregates minima map-side and joins them back, so a hub's
    neighbours never meet in one task's memory. Edge lists only shrink or keep
    their size: every edge is replaced by at most one.
    """
    now, mark = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None
    while True:
        now = store.keep(now.repartition("u").mapInArrow(_contract, "u long, v long").distinct(), "edges")
        changed = _mark(now)
        if changed == mark or not changed[0]:
            break
        if 2 * changed[0] <= RUN_NODES:
            # what is left fits one run, whose stars are the components
            now = store.keep(now.coalesce(1).mapInArrow(_contract, "u long, v long"), "edges")
            break
        mark = changed
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        now = store.keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    low = now.groupBy("u").agg(F.min("v").alias("component"))
    out = low.select(F.col("u").alias("node"), "component").union(low.select(F.col("component").alias("node"), "component").distinct())
    return store.keep(out, "components")
