"""Bulk-synchronous best-fit packing of token sequences.

Documents and gaps are classes by length, at most ``capacity`` of either, so
the range-sorted sweep state is bounded by the capacity, never by the rows. A
superstep takes the documents of one length, longest first: a successor
search gives them the smallest gap that holds them, documents that want the same
gap are dealt over its sequences by rank, and the gaps are updated. What no
gap holds opens new sequences. The outcome is that of best-fit decreasing over the
single documents. The supersteps leave runs of ranks to place; ranks
within a length and the placing itself are distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Store
from .text import buffers, released
from .tokens import encoder

SALTS, ROWS_A_SALT = 64, 100_000
#: Texts are encoded in runs of so many bytes, in which many chunks repeat.
ENCODE_BYTES = 1 << 22
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, documents a sequence, place of the first) that place every rank of every length, sorted."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(order, length)
            if k == len(order):
                gap, n = capacity, -(-left // (capacity // length))
                first, opened = opened, opened + n
            else:
                gap = order[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - gap))
                free(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than fill one sequence
                runs.append((length, rank, first + full, left, capacity - gap))
                free(gap - left * length, first + full, 1)
                full, left = full + 1, 0
            free(gap, first + full, n - full)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    tail = np.array([end_id], "<u4").tobytes()

    @released
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            data, at = buffers(batch.column(1))
            ids, i, n = batch.column(0).to_pylist(), 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(at, at[i] + ENCODE_BYTES, "right")) - 1)
                out = ([], [], [], [], [], [])
                for k, seq in zip(range(i, j), coder.encode([data[at[k] : at[k + 1]].tobytes() for k in range(i, j)]), strict=True):
                    seq += tail
                    for p, b in enumerate(range(0, len(seq), 4 * capacity)):
                        part = seq[b : b + 4 * capacity]
                        for col, v in zip(out, (ids[k], p, b // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                            col.append(v)
                columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], names[: 5 + with_ids])
                i = j

    return run


def _place(runs: np.ndarray):
    @released
    def run(batches):
        # keys of runs: length in the high bits, rank in the low ones
        key = (runs[:, 0] << 48) | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = runs[np.searchsorted(key, (length << 48) | rank, "right") - 1] if len(runs) else np.zeros((0, 5), np.int64)
            k = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([c for c, f in zip(batch.columns, batch.schema.names, strict=True) if f != "rank"] + [pa.array(r[:, 2] + k // r[:, 3]), pa.array(r[:, 4] + k % r[:, 3] * length)], [f for f in batch.schema.names if f != "rank"] + ["sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each row of docs.

    A document is its tokens and then end_id; a null or empty text is end_id
    alone. Those longer than capacity are cut into pieces of it, the last one shorter.
    Pieces of equal length are ranked by doc_id and piece; a null doc_id is a value like any other
    (first), repeated rows are packed each. ids: little-endian unsigned 32-bit numbers.
    An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    if capacity >= 1 << 15:
        raise ValueError("capacity must be under 32768")
    store = Store(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = store.keep(texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), _PIECES + ", ids binary" * with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = SALTS + sum(counts.values()) // ROWS_A_SALT
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).select(*pieces.columns, (F.col("before") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_place(plan(counts, capacity)), pieces.schema.add("sequence_id", "long").add("offset", "long"))
