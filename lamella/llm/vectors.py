"""What the vector operators share: usable vectors as bytes, matrices from bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import released


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, dim): v is the vector as little-endian doubles, null where it is null, empty, or has a null or non-finite component. Zeros have one sign."""

    @released
    def run(batches):
        for batch in batches:
            out, dim = [], []
            for x in batch.column(1).to_pylist():
                a = np.array([np.nan if c is None else c for c in x] if x else [np.nan], np.float64)
                ok = bool(np.isfinite(a).all())
                out.append((a + 0.0).tobytes() if ok else None)
                dim.append(len(a) if ok else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(dim, pa.int32())], ["vec_id", "v", "dim"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary, dim int")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def sample_of(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of a column: the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64(order), order).limit(n)
