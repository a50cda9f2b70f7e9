"""Hashes dealt to parts in packets: a row of bytes for each slice and part, not a row for each hash."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store
from .text import U, mix, released

#: Bits of the filter that keeps documents without a meeting out of the second shuffle: 16 a document, between these bounds.
#: Beyond the upper one (8 MB) it lets more documents through, which costs shuffle and changes no result.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Tasks of a shuffle by part. Parts are as many as the entries ask for; a task takes its parts one after the other.
MOST_TASKS = 20_000


def part_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.uint16 if n < 1 << 16 else np.uint32)


def dealt(packets: DataFrame, n: int) -> DataFrame:
    """Packets of n parts, a part's in one task and together; a task has several parts where there are more of them than MOST_TASKS."""
    tasks = min(n, MOST_TASKS)
    return packets.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")


def runs(batches) -> Iterator[pa.Table]:
    """The rows of each part, from sorted batches whose first column is the part: a task holds one part at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != part[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The bytes of all values of a column, nulls as none, as one array of numbers."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


class Filter(NamedTuple):
    """Bits of a set of numbers: a kept table of one row (bits), or of none if the set is empty."""

    table: DataFrame
    n_bits: int

    def bits(self) -> bytes:
        row = self.table.first()
        return bytes(row["bits"]) if row else bytes(self.n_bits // 8)


def _folded(n_words: int):
    """One row with all words in their places."""

    @released
    def run(batches):
        words = np.zeros(n_words, np.int64)
        for batch in batches:
            words[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary())], ["bits"])

    return run


def filter_of(keys: DataFrame, number: Column | None = None) -> Filter:
    """Bits of which that of each key's number is set. keys: a kept table; number: a long, by default a hash of (doc_id, tie)."""
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", "tie") if number is None else number, F.lit(n_bits))
    # 64 bits to a row, so at most MOST_BITS / 64 rows meet in the task that folds them
    words = keys.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    return Filter(Store(keys.sparkSession, "filter").keep(words.repartition(1).mapInArrow(_folded(n_bits // 64), "bits binary")), n_bits)


def might_hold(filter_: Filter, *names: str) -> Column:
    """Whether the filter holds the hash of a row's columns, by default that of its document (doc_id, tie).

    The bits are a subquery: as a literal they would be written out, twice their size, wherever Spark describes the plan.
    """
    place = F.pmod(F.xxhash64(*(names or ("doc_id", "tie"))), F.lit(filter_.n_bits))
    byte = F.conv(F.hex(F.substring(filter_.table.scalar(), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0, F.lit(False))


KEY_PACKET = "part int, low binary, high binary, node binary"


def key_packets(key: np.ndarray, node: np.ndarray, n_parts: int) -> pa.RecordBatch:
    """Packets of (key, node): 13 bytes for each, a part's share of the key being in the part."""
    part = part_of(key, n_parts)
    order = np.argsort(part, kind="stable")
    part, key, node = part[order], key[order], node[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, int)
    low, high = key.astype(np.uint32), (mix(key) & U(255)).astype(np.uint8)

    def take(x: np.ndarray) -> pa.Array:
        return pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())

    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), take(low), take(high), take(node)], ["part", "low", "high", "node"])


@released
def shared(batches):
    """Of each part: the distinct (key, node) of keys that two nodes or more have."""
    for rows in runs(batches):
        part = U(rows.column(0)[0].as_py())
        high = joined(rows.column(2), np.uint8).astype(np.uint64)
        key = (part << U(40)) | (joined(rows.column(1), np.uint32).astype(np.uint64) << U(8)) | high
        node = joined(rows.column(3), np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.cumsum(first) - 1
        many = (np.bincount(group) > 1)[group]
        key, node = key[many].view(np.int64), node[many]
        for k in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), pa.array(node[k : k + 100_000])], ["key", "node"])
