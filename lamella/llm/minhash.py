"""Near-duplicate documents by HyperMinHash sketches, banding, and an exact check on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linkage import link
from .packets import KEY_PACKET, dealt, filter_of, key_packets, might_hold, shared
from .rows import NEVER, key_of, met
from .store import Store, parts
from .text import U, Words, constants, mix, released, roll, slices

BANDS, ROWS = 42, 6
K = BANDS * ROWS
PART_ENTRIES = 500_000
#: Size class c takes sets of 4^c to 1.25 * 4^(c+1) elements. Two sets at similarity 0.8 differ by at most a
#: fifth in size, so they share a class; sets in the overlap get a sketch for either.
CLASSES = 24
MANTISSA = 10
#: Chance that registers of unlike elements agree: equal leading-zero counts (about 1/3) and mantissas.
COLLISION = 2.0**-MANTISSA / 3
EMPTY = np.uint16(65535)
_MUL, _XOR = constants(1024, 11), constants(1024, 12)


def size_classes(n: int) -> list[int]:
    return [c for c in range(CLASSES) if 4**c <= n and 4 * n <= 5 * 4 ** (c + 1)]


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(words: Words, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: n words each, or all words if there are fewer."""
    h = words.hashes()
    windows = roll(h, n)
    for i, j in zip(words.first[:-1], words.first[1:], strict=True):
        if j - i >= n:
            yield distinct(windows[i : j - n + 1])
        elif j > i:
            yield mix(roll(h[i:j], int(j - i)) + U(j - i))
        else:
            yield h[:0]


def _register(low: np.ndarray) -> np.ndarray:
    """Leading-zero count (6 bits) and the MANTISSA bits after the leading one, of bucket minima."""
    high = low >> U(11)  # 53 bits, exact in a double
    _, exponent = np.frexp(high.astype(np.float64))
    zeros = 53 - exponent
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | ((high >> shift) & U((1 << MANTISSA) - 1)).astype(np.uint16)


def sketch(s: np.ndarray, size_class: int) -> np.ndarray:
    """K registers of one permutation over all buckets; sets of small classes enter with so many
    independent images of each element that every bucket gets some. A bucket left empty holds EMPTY."""
    images = max(1, -(-1024 // 4**size_class))
    z = mix((s[:, None] ^ _XOR[:images]) * _MUL[:images]).ravel()
    bucket = ((z >> U(32)) * U(K) >> U(32)).astype(np.intp)
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bucket, z << U(32))
    out = _register(low)
    out[low == np.iinfo(np.uint64).max] = EMPTY
    return out


def _band_keys(sketch: np.ndarray, tag: int) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.full(BANDS, tag, np.uint64) + np.arange(BANDS, dtype=np.uint64) * U(CLASSES)
    for k in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, k])
    return key


_SKETCHES = "doc_id long, tie long, n_shingles long, digest binary, mark binary"


def _digest(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _sketch(n: int):
    @released
    def run(batches):
        for batch in batches:
            for i, j, words in slices(batch.column(2), lower=True):
                size, digest, mark = [], [], []
                for x in shingle_sets(words, n):
                    size.append(len(x))
                    digest.append(_digest(x))
                    two = np.zeros(2, _MARK)
                    two["c"] = -1
                    for k, c in enumerate(size_classes(len(x))):
                        two[k] = c, sketch(x, c)
                    mark.append(two.tobytes() if len(x) else None)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(mark, pa.binary())], ["doc_id", "tie", "n_shingles", "digest", "mark"])

    return run


def _bands(n_parts: int):
    @released
    def run(batches):
        for batch in batches:
            node, keys = [], []
            for i, mark in zip(batch.column("node").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                for c, x in np.frombuffer(mark, _MARK):
                    if c >= 0:
                        node.append(i)
                        keys.append(_band_keys(x, int(c)))
            if keys:
                yield key_packets(np.concatenate(keys), np.repeat(np.array(node, np.int64), BANDS), n_parts)

    return run


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities of sketches x with sketches y, row by row or one with many, and the registers used: from equal registers, less what those of unlike elements add."""
    full = (x != EMPTY) | (y != EMPTY)
    used = np.maximum(1, full.sum(-1))
    same = ((x == y) & full).sum(-1)
    return np.maximum(0.0, (same / used - COLLISION) / (1 - COLLISION)), used


def _worth(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether estimates are within five standard deviations of the threshold, or above."""
    t = percent / 100
    j, used = estimate(x, y)
    return j >= t - 5 * np.sqrt(t * (1 - t) / used)


_MARK = np.dtype([("c", np.int32), ("s", np.uint16, K)])


def _sets(n: int):
    """(digest, sorted shingle hashes) of each text."""

    @released
    def run(batches):
        for batch in batches:
            for _, _, words in slices(batch.column(0), lower=True):
                sets = list(shingle_sets(words, n))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "content"])

    return run


def _likely(percent: int):
    """Hubs against members by estimate, on the size classes that they share."""

    def one(hubs: list, members: list, ask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(ask)
        h, m = (np.frombuffer(b"".join(x), _MARK).reshape(len(x), 2) for x in (hubs, members))
        for i in (0, 1):
            for k in np.flatnonzero(h["c"][:, i] >= 0):
                for j in (0, 1):
                    to = np.flatnonzero((m["c"][:, j] == h["c"][k, i]) & ask[k])
                    if len(to):
                        out[k, to] |= _worth(h["s"][k, i], m["s"][to, j], percent)
        return out

    return lambda blocks: [one(*block) for block in blocks]


def _test(percent: int):
    """Hubs against members by their full sets."""

    def one(hubs: list, members: list, ask: np.ndarray) -> np.ndarray:
        out = np.zeros_like(ask)
        wanted = np.flatnonzero(ask.any(0))
        sets = [np.frombuffer(members[m], np.uint64) for m in wanted]
        size = np.array([len(x) for x in sets])
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        for k in np.flatnonzero(ask.any(1)):
            mine = np.frombuffer(hubs[k], np.uint64)
            place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            flag = np.zeros(len(known), np.int64)
            flag[place[known[place] == mine]] = 1
            both = np.add.reduceat(flag[ids], begin)
            out[k, wanted] = (100 * both >= percent * (len(mine) + size - both)) & ask[k, wanted]
        return out

    return lambda blocks: [one(*block) for block in blocks]


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each near-duplicate group: that of its smallest doc_id; columns as they were.

    Equal rows are one document, of which one row stays. Of different texts under one doc_id each stays that is its own
    group's first. A row without doc_id links with nothing, so it stays, once for each text. Null and empty texts link with nothing.
    """
    store = Store(docs.sparkSession, "copies")
    found = near_duplicates(docs, words, percent, with_tie=True)
    rows = found.select(F.coalesce("doc_id", F.lit(NEVER)).alias("doc_id"), "tie", "kept").groupBy("doc_id", "tie").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    # rows that go, or of which there are several
    whole, some, (id_, tie, kept) = met(docs, store.keep(rows.where("not kept or n > 1").select("doc_id", "tie", "kept"), "copies"), "kept")
    one = some.where(F.coalesce(F.col(kept), F.lit(True))).dropDuplicates([id_, tie])
    return whole.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_tie: bool = False) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept[, tie, a hash of the text]) for each row of docs.

    Documents link if 100 * |A & B| >= percent * |A | B| over their sets of
    ``words``-word shingles (A-Z lower-cased; fewer words: the whole sequence).
    Rows with equal sets are one node, named after its smallest doc_id, a component after its nodes' smallest one.
    Different texts under one doc_id are nodes of their own, and each row tells its own text's component. A text that is null or has no word has
    an empty set and links with nothing; a null doc_id links with nothing and
    is its own (null) component, kept. Repeated rows each get a row; an empty table gives none. Other
    columns are ignored, whatever their names.

    percent must be 80 or more: size classes overlap for sizes that differ by a fifth.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    store = Store(docs.sparkSession, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), key_of(id_col, text_col)[1], F.col(text_col).cast("string").alias("text"))
    sketches = store.keep(texts.mapInArrow(_sketch(words), _SKETCHES).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = sketches.where("doc_id is not null and digest is not null")
    # the first row of a set stands for all that have it
    classes = store.keep(known.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("digest", F.col("f.row").alias("node"), F.col("f.doc_id").alias("low")), "classes")
    # sketches of rows that cannot be another's copy stay where they are
    copies = store.keep(known.select("row", "digest").join(classes, "digest").where("row <> node").select("row"), "others")
    is_copy, own = might_hold(filter_of(copies, F.xxhash64("row")), "row"), [F.col("row").alias("node"), "mark"]
    nodes = store.keep(known.where(~is_copy).select(*own).unionByName(known.where(is_copy).select(*own).join(classes.select("node"), "node", "left_semi")), "nodes")
    store.drop(copies)
    slim = store.keep(sketches.select("doc_id", "n_shingles", "digest", *["tie"] * with_tie), "rows")
    store.drop(sketches)
    n_parts = max(parts(docs.sparkSession), nodes.count() * BANDS // PART_ENTRIES)
    buckets = store.keep(dealt(nodes.mapInArrow(_bands(n_parts), KEY_PACKET), n_parts).mapInArrow(shared, "key long, node long"), "buckets")
    busy = store.keep(classes.join(buckets.select("node").distinct(), "node", "left_semi"), "busy")
    marks = store.keep(nodes.join(busy.select("node"), "node", "left_semi").select("node", F.col("mark").alias("content")), "marks")
    store.drop(nodes)
    ids = busy.select(F.col("low").alias("doc_id"), F.lit(0).alias("tie"))
    near = texts.select("doc_id", F.lit(0).alias("tie"), "text").where(F.col("doc_id").isNotNull() & might_hold(filter_of(ids)))
    sets = near.select("text").mapInArrow(_sets(words), "digest binary, content binary").where("digest is not null")
    content = store.keep(sets.join(busy.select("digest", "node"), "digest").dropDuplicates(["node"]).select("node", "content"), "content")
    found = link(store, buckets, content, _test(percent), marks, _likely(percent), once=16)
    store.drop(content, marks, buckets, busy)
    named = classes.join(found, "node", "left").select("digest", "low", F.coalesce("component", "node").alias("c"))
    names = named.groupBy("c").agg(F.min("low").alias("component_id"))
    out = slim.join(named.join(names, "c").select("digest", "component_id"), "digest", "left")
    c = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(F.col("doc_id") == c, F.lit(True)).alias("kept"), *["tie"] * with_tie)
