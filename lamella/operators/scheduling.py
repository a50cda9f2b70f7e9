"""Work requests: order, coalescing, generations, caches."""

from __future__ import annotations

from array import array
from collections import OrderedDict, deque
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aged_priority(priority: Column, age: Column, quantum: int, cap: int) -> Column:
    """A smaller number goes first; waiting lowers it by one a quantum, up to cap."""
    return priority - F.least(F.floor(age / quantum), F.lit(cap)).cast("int")


def coalesced(requests: DataFrame, keys: list[str], seq: str, payload: str) -> DataFrame:
    """One request a key: the newest payload at the first one's place in the queue."""
    return requests.groupBy(*keys).agg(F.max_by(payload, seq).alias(payload), F.min(seq).alias("enqueued"), F.count("*").alias("n_submitted"))


def gated(work: DataFrame, session: str, seq: str, generation: str) -> DataFrame:
    """Work that is not older than any generation its session has shown before it."""
    seen = F.max(generation).over(Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return work.where(F.lit(True)).withColumn("_seen", seen).where(F.col(generation) >= F.col("_seen")).drop("_seen")


def arbitrate(completions: DataFrame, sessions: DataFrame, session: str, generation: str) -> DataFrame:
    """Each completion with its decision against the session's current generation (current, closed)."""
    joined = completions.join(sessions, session, "left")
    decision = F.when(F.col("current").isNull(), "discard-unknown-session").when(F.col("closed"), "discard-closed").when(F.col(generation) < F.col("current"), "discard-stale").otherwise("publish")
    return joined.withColumn("decision", decision)


def lru(accesses: DataFrame, partition: str, seq: str, key: str, weight: str, entries: int, capacity: int) -> DataFrame:
    """(partition, seq, hit, evicted, held) of every access to a cache of each partition, bounded by entries and by weight; what alone is too heavy is not admitted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict = OrderedDict()
        total, out = 0, []
        for row in pdf.sort_values([seq, key]).itertuples(index=False):
            k, w, s = getattr(row, key), int(getattr(row, weight)), getattr(row, seq)
            hit, evicted = k in held, 0
            if hit and held[k] == w:
                held.move_to_end(k)
            elif hit:  # the same key with another weight is replaced
                total -= held.pop(k)
            if k not in held and w <= capacity:
                held[k], total = w, total + w
                while len(held) > entries or total > capacity:
                    _, gone = held.popitem(last=False)
                    total, evicted = total - gone, evicted + 1
            out.append((getattr(row, partition), s, hit, evicted, total))
        return pd.DataFrame(out, columns=[partition, seq, "hit", "evicted", "held"])

    return accesses.select(partition, seq, key, weight).groupBy(partition).applyInPandas(run, f"{partition} long, {seq} long, hit boolean, evicted int, held long")


def fair_order(queue: DataFrame, worker: str, session: str, seq: str, burst: int) -> DataFrame:
    """Dispatch order in which sessions of a worker take turns of at most `burst` requests: closed form, no loop."""
    turn = F.floor((F.row_number().over(Window.partitionBy(worker, session).orderBy(seq)) - 1) / burst)
    first = F.min(seq).over(Window.partitionBy(worker, session))
    out = queue.withColumn("turn", turn).withColumn("_first", first)
    return out.withColumn("position", F.row_number().over(Window.partitionBy(worker).orderBy("turn", "_first", session, seq))).drop("_first")


def _order(first: np.ndarray, rank: np.ndarray, burst: int) -> np.ndarray:
    """Places in `rank` in order of dispatch: of the sessions served less than `burst` turns after the one served longest ago, the one whose next request ranks first.

    rank: the requests' ranks, each session's rising and together, from first[session] on; first ends with their number.
    """
    first, rank, out = first.tolist(), array("q", rank.astype(np.int64).tobytes()), np.empty(len(rank), np.int64)
    n = len(first) - 1
    place, last, turn = first[:-1], [0] * n, 0
    oldest = [(0, s) for s in range(n)]
    ready = [(rank[k], s) for s, k in enumerate(place)]
    held: deque = deque()  # served sessions with work left, in the order of their turns
    heapify(ready)
    while ready or held:
        while place[oldest[0][1]] == first[oldest[0][1] + 1] or last[oldest[0][1]] != oldest[0][0]:
            heappop(oldest)
        while held and last[held[0]] < oldest[0][0] + burst:
            s = held.popleft()
            heappush(ready, (rank[place[s]], s))
        _, s = heappop(ready)
        out[turn] = place[s]
        turn += 1
        place[s], last[s] = place[s] + 1, turn
        if place[s] < first[s + 1]:
            held.append(s)
            heappush(oldest, (turn, s))
    return out


def _turns(waiting: dict, burst: int) -> list[tuple[int, object, int]]:
    """(turn, session, place in its queue) of each dispatch of sessions with their sorted keys, by `_order`."""
    sessions, keys = list(waiting), sorted(k for of in waiting.values() for k in of)
    number = {k: n for n, k in enumerate(keys)}
    first = np.cumsum([0, *map(len, waiting.values())])
    out = _order(first, np.array([number[k] for of in waiting.values() for k in of], np.int64), burst)
    owner = np.searchsorted(first, out, "right") - 1
    return [(n + 1, sessions[s], int(k - first[s])) for n, (s, k) in enumerate(zip(owner, out, strict=True))]


def dispatched(queue: DataFrame, worker: str, session: str, keys: list[str], burst: int) -> DataFrame:
    """Rows (worker, session, *keys, position): the order in which a worker takes up its queue by `_order`, where each choice hangs on those before. Keys order the requests and are unique in a worker.

    A worker's queue is bounded by its capacity and one task's work, at a few arrays of numbers; workers are independent.
    """
    names = [worker, session, *keys]
    fields = ", ".join(f"{n} {dict(queue.dtypes)[n]}" for n in names) + ", position long"

    def run(rows: pa.Table) -> pa.Table:
        rank = np.empty(rows.num_rows, np.int64)
        rank[pc.sort_indices(rows, [(k, "ascending") for k in keys]).to_numpy()] = np.arange(rows.num_rows)
        of = rows.column(session).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        by = np.lexsort((rank, of))
        first = np.append(np.flatnonzero(np.diff(of[by], prepend=-1)), len(by))
        out = rows.take(pa.array(by[_order(first, rank[by], burst)]))
        return out.append_column("position", pa.array(np.arange(1, len(by) + 1)))

    return queue.select(names).groupBy(worker).applyInArrow(run, fields)


def segmented(accesses: DataFrame, partition: str, seq: str, key: str, viewport: str, entries: int) -> DataFrame:
    """(partition, seq, hit, evicted) of a cache whose tiles of the current viewport are protected: others are evicted first, either kind oldest first. A new viewport leaves the old one's tiles unprotected."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        out = []
        for n, row in enumerate(pdf.sort_values(seq).itertuples(index=False)):
            k, v = getattr(row, key), getattr(row, viewport)
            hit, evicted = k in held, None
            held[k] = n, v
            if len(held) > entries:
                evicted = min((x for x in held if x != k), key=lambda x: (held[x][1] == v, held[x][0]))
                del held[evicted]
            out.append((getattr(row, partition), getattr(row, seq), hit, evicted))
        out = pd.DataFrame(out, columns=[partition, seq, "hit", "evicted"])
        out["evicted"] = out["evicted"].astype("Int64")
        return out

    return accesses.select(partition, seq, key, viewport).groupBy(partition).applyInPandas(run, f"{partition} long, {seq} long, hit boolean, evicted long")
