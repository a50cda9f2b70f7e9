"""Exact top-k by integer inner product over KD-trees, one for each shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store
from .vectors import matrix, sample_of, usable

LEAF, SHARD_ROWS, QUERY_ROWS, FIRST_ROWS = 64, 8192, 2048, 2048
#: Integers up to this size have products whose sums are exact in a double, for up to 2^12 dimensions.
EXACT = float(1 << 20)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
_HITS = "query_id long, vec_id long, score long"


class Tree:
    """Median splits on the widest dimension; every node has the tight box of its points."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.kids: list[tuple[int, int] | None] = []
        self.lo, self.hi, self.least, self.part = [], [], [], []
        self._grow(x, ids)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _grow(self, x: np.ndarray, ids: np.ndarray) -> int:
        me = len(self.kids)
        lo, hi = x.min(0), x.max(0)
        self.kids.append(None)
        self.lo.append(lo)
        self.hi.append(hi)
        self.least.append(int(ids.min()))
        self.part.append(None)
        if len(x) <= LEAF or not (hi > lo).any():
            order = np.argsort(ids, kind="stable")
            self.part[me] = x[order], ids[order]
        else:
            order = np.argpartition(x[:, np.argmax(hi - lo)], len(x) // 2)
            left, right = order[: len(x) // 2], order[len(x) // 2 :]
            self.kids[me] = self._grow(x[left], ids[left]), self._grow(x[right], ids[right])
        return me

    def search(self, q: np.ndarray, bound: np.ndarray, own: int, k: int, kth: float) -> list[tuple[int, int]]:
        """The k best (score, id) of score kth or more: best box first, until no box can change them. Ties go to the smaller id."""
        best: list[tuple[float, int]] = []  # a heap, worst first
        queue = [(-bound[0], 0)]
        while queue:
            top, node = heapq.heappop(queue)
            worst = best[0] if len(best) == k else (kth, -float("inf"))
            if -top < worst[0]:
                break
            if len(best) == k and -top == worst[0] and self.least[node] >= -worst[1]:
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    heapq.heappush(queue, (-bound[kid], kid))
                continue
            x, ids = self.part[node]
            scores = _held(x @ q)
            for i in np.flatnonzero(scores >= worst[0]):
                if ids[i] != own:
                    entry = (scores[i], -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
        return [(int(s), -i) for s, i in best]


def _levels(v: np.ndarray, scale: float) -> np.ndarray:
    x = np.floor(v * scale)
    return x if not x.size or np.abs(x).max() <= EXACT else np.array([[int(c) for c in r] for r in x], object)


def _held(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long as the nearest one; those of doubles are exact and far below."""
    return np.minimum(np.maximum(scores, LOW), HIGH) if scores.dtype == object else scores


def _search(k: int, scale: float):
    def run(table: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        is_query = table.column("query").to_numpy(zero_copy_only=False)
        q, c = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        if q.num_rows and c.num_rows:
            x, y = _levels(matrix(c.column("v")), scale), _levels(matrix(q.column("v")), scale)
            tree = Tree(x, c.column("vec_id").to_numpy())
            lo, hi = tree.lo, tree.hi
            bounds = _held(np.maximum(y, 0) @ hi.T + np.minimum(y, 0) @ lo.T)
            for row, bound, own, kth in zip(y, bounds, q.column("vec_id").to_pylist(), q.column("kth").to_pylist(), strict=True):
                for score, i in tree.search(row, bound, own, k, -float("inf") if kth is None else kth):
                    for col, value in zip(out, (own, i, score), strict=True):
                        col.append(value)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(table: DataFrame, queries, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over floor(scale * x), ties to the smaller vec_id.

    queries: a condition on vec_id. Every other row is a candidate; a row with
    the query's own vec_id is not. A repeated query row is asked once. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without vec_id; vectors of unlike length
    do not meet. A score that a long cannot hold is the nearest long, for ranks, too. Repeated (vec_id, vector) rows are each a candidate of their own.

    A first search over FIRST_ROWS candidates gives each query a kth score, which goes with
    it to all shards, as a bound that only better boxes pass.
    """
    spark = table.sparkSession
    store = Store(spark, "topk")
    rows = store.keep(usable(table).where("v is not null and vec_id is not null"), "rows")
    hits = None
    for dim, n, asked in sorted((r["dim"], r["n"], r["asked"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(queries).alias("asked")).collect()):
        if not asked:
            continue
        of = rows.where(F.col("dim") == dim).select("vec_id", "v")
        shards, blocks = -(-n // SHARD_ROWS), -(-asked // QUERY_ROWS)
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")

        def meet(candidates: DataFrame, asking: DataFrame, shards: int) -> DataFrame:
            shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
            c = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard.alias("shard"), "vec_id", "v", F.lit(False).alias("query"), F.lit(None).cast("long").alias("kth"))
            q = asking.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(True).alias("query"), "kth")
            return c.unionByName(q).groupBy("block", "shard").applyInArrow(_search(k, scale), _HITS)

        asking = of.where(queries).dropDuplicates(["vec_id", "v"])
        first = meet(sample_of(of, "vec_id", FIRST_ROWS), asking.withColumn("kth", F.lit(None).cast("long")), 1)
        kth = store.keep(first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth")), "kth")
        one = meet(of, asking.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left"), shards)
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
