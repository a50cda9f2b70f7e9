"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are turned so that leading dimensions hold most of their length.
A tile adds up the leading dimensions first; the rest of a product is at most the
product of the suffix norms, so most pairs stop there. Pairs that reach
the end are decided on the unturned vectors. Blocks are ranges of the first
coordinate: pairs of blocks too far apart on it for any link are not made at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import Store
from .text import released
from .vectors import matrix, sample_of, usable

BLOCK_ROWS, TILE, SAMPLE_ROWS, SLACK = 4096, 512, 8192, 1e-7
_FOUND = "a long, b long, links long"


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _leads(dim: int) -> list[int]:
    return sorted({max(1, dim // 4), max(1, dim // 2), dim})


def near_pairs(a: np.ndarray, b: np.ndarray, at_least: float, leads: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of rows (unit, turned) whose product may reach at_least: leading dimensions first, the rest bounded by suffix norms."""
    p = a[:, : leads[0]] @ b[:, : leads[0]].T
    rest = [np.sqrt(np.maximum(0, (x[:, leads[0] :] ** 2).sum(1))) for x in (a, b)]
    i, j = np.nonzero(p + rest[0][:, None] * rest[1] >= at_least - SLACK)
    p = p[i, j]
    for low, high in zip(leads, leads[1:], strict=False):
        if not len(i):
            break
        if 4 * len(i) > len(a) * len(b) // 4:
            p += (a[:, low:high] @ b[:, low:high].T)[i, j]
        else:
            for k in range(0, len(i), 65536):
                s = slice(k, k + 65536)
                p[s] += np.einsum("ij,ij->i", a[i[s], low:high], b[j[s], low:high])
        rest = [np.sqrt(np.maximum(0, (x[:, high:] ** 2).sum(1))) for x in (a, b)]
        ok = p + rest[0][i] * rest[1][j] >= at_least - SLACK
        i, j, p = i[ok], j[ok], p[ok]
    return i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows taken pairwise, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _star(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place reachable from each of n, over edges i-j."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(at_least: float, basis: np.ndarray):
    """For one pair of blocks: links of each row (counting copies), and a spanning star of each component."""
    leads = _leads(len(basis))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("node", "ascending")])
        node, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "side"))
        raw = matrix(table.column("v"))
        raw = raw / np.abs(raw).max(1, keepdims=True) if len(raw) else raw
        turned = _unit(raw) @ basis if len(raw) else raw
        cut = int(np.searchsorted(side, 1))
        same = cut == len(node)  # a block with itself
        links, edges = np.zeros(len(node), np.int64), []
        for x in range(0, cut, TILE):
            for y in range(x if same else cut, len(node), TILE):
                ends = min(x + TILE, cut), min(y + TILE, len(node))
                i, j = near_pairs(turned[x : ends[0]], turned[y : ends[1]], at_least, leads)
                i, j = i + x, j + y
                if same:
                    i, j = i[i < j], j[i < j]
                ok = np.zeros(len(i), bool)
                for k in range(0, len(i), 65536):
                    ok[k : k + 65536] = cosines(raw[i[k : k + 65536]], raw[j[k : k + 65536]]) >= at_least
                i, j = i[ok], j[ok]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    own = np.unique(np.concatenate((i, j)))
                    low = _star(np.searchsorted(own, i), np.searchsorted(own, j), len(own))
                    edges.append(np.stack((own[low], own))[:, low != np.arange(len(own))])
        a, b = (node[e] for e in np.concatenate(edges, 1)) if edges else (node[:0], node[:0])
        own = np.flatnonzero(links)
        none = pa.nulls(len(own), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(a), pa.array(node[own])]), "b": pa.concat_arrays([pa.array(b), none]), "links": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(links[own])])})

    return run


def _blocks(basis: np.ndarray, splits: np.ndarray, reach: float, per_bin: np.ndarray):
    """Rows once for each pair of blocks that they take part in. A bin of the first coordinate is per_bin[bin] blocks, dealt by hash."""
    first = np.concatenate(([0], np.cumsum(per_bin)))
    edges = np.concatenate(([-np.inf], splits, [np.inf]))

    @released
    def run(batches):
        for batch in batches:
            x = _unit(matrix(batch.column("v"))) @ basis[:, :1] if batch.num_rows else np.zeros((0, 1))
            mine = np.searchsorted(splits, x[:, 0], "right")
            dealt = batch.column("deal").to_numpy()
            row, i, j, side = [], [], [], []
            for b in np.unique(mine):
                # bins whose range comes within reach of this bin's range: a pair of bins decides alike from either side
                near = np.flatnonzero((edges[1:] >= edges[b] - reach - SLACK) & (edges[:-1] <= edges[b + 1] + reach + SLACK))
                others = np.concatenate([np.arange(first[n], first[n + 1]) for n in near])
                rows = np.flatnonzero(mine == b)
                block = first[b] + dealt[rows] % per_bin[b]
                row.append(np.repeat(rows, len(others)))
                here, there = np.repeat(block, len(others)), np.tile(others, len(rows))
                i.append(np.minimum(here, there))
                j.append(np.maximum(here, there))
                side.append((here > there).astype(np.int8))
            if row:
                taken = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(i)), pa.array(np.concatenate(j)), pa.array(np.concatenate(side)), *(batch.column(c).take(taken) for c in ("node", "copies", "v"))], ["i", "j", "side", "node", "copies", "v"])

    return run


def near_vectors(table: DataFrame, at_least: float = 0.9) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of table (vec_id, embedding).

    Two rows link if the cosine of their vectors is at_least or more, in double
    precision. Rows with equal vectors are one node with a number of copies, and
    link with one another. A vector that is null, empty, zero, or has null or
    non-finite components links with nothing; so do vectors of unlike length. A
    null vec_id counts as a copy in others' n_links but is no component's name: its own
    component_id is that of its vector's other rows. Other columns are ignored.

    The basis comes from SAMPLE_ROWS vectors; it orders the work and changes no result.
    """
    spark = table.sparkSession
    store = Store(spark, "embeddings")
    zero = F.expr("v is null or length(replace(hex(v), '0', '')) = 0")
    rows = store.keep(usable(table).withColumn("v", F.when(~zero, F.col("v"))), "rows")
    classes = store.keep(rows.where("v is not null").groupBy("v", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = None
    for dim, n in sorted((r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        of = classes.where(F.col("dim") == dim)
        sample = sample_of(of, "node", SAMPLE_ROWS).select("v").toPandas()
        x = _unit(np.frombuffer(b"".join(sample["v"]), np.float64).reshape(-1, dim))
        basis = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
        bins = max(1, n // BLOCK_ROWS)
        splits = np.unique(np.quantile(x @ basis[:, 0], np.arange(1, bins) / bins)) if bins > 1 else np.zeros(0)

        @released
        def bin_of(batches, basis=basis, splits=splits):
            for batch in batches:
                x = _unit(matrix(batch.column("v"))) @ basis[:, :1] if batch.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(splits, x[:, 0], "right"))], ["bin"])

        per_bin = np.ones(len(splits) + 1, np.int64)
        if bins > 1:
            for r in of.select("v").mapInArrow(bin_of, "bin long").groupBy("bin").count().collect():
                per_bin[r["bin"]] = -(-r["count"] // BLOCK_ROWS)
        reach = float(np.sqrt(max(0.0, 2 - 2 * at_least)))
        dealt = of.select("node", "copies", "v", F.pmod(F.xxhash64("node"), F.lit(1 << 30)).alias("deal"))
        tiles = dealt.mapInArrow(_blocks(basis, splits, reach, per_bin), "i long, j long, side byte, node long, copies long, v binary")
        one = tiles.groupBy("i", "j").applyInArrow(_compare(at_least, basis), _FOUND)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = store.keep(found, "found")
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(store, found.where("b is not null").select("a", "b"))
    named = classes.join(linked, "node", "left").join(joined, "node", "left").select("v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    names = named.groupBy("c").agg(F.min("low").alias("component_id"))
    out = rows.join(named.join(names, "c").select("v", "n_links", "component_id"), "v", "left")
    c = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), c.alias("component_id"), F.coalesce(F.col("vec_id") == c, F.lit(True)).alias("kept"))
