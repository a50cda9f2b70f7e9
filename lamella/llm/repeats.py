"""Removal of repeated passages by fixed-block anchors.

A window of W words that occurs twice holds, in either place, a whole block of
B = W // 2 words that starts at a multiple of B. So the non-overlapping blocks
of every document are the index and every rolling run of B words is a probe.
Where a probe meets a block, the W-word windows around it are the only ones that can
repeat; their exact repeats are found next and make up the maximal repeats.

Hashes travel in packets: a slice of documents sends each hash part one row
of bytes, about 7 bytes a probe, not a row for each. What repeats
inside a slice is settled there, so a passage found everywhere reaches a hash part
at most once from each slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packets import dealt, filter_of, joined, might_hold, part_of, runs
from .rows import NEVER, key_of, met
from .store import Store, parts
from .text import U, buffers, mix, released, roll, slices

PART_ENTRIES = 500_000
_INDEX, _MANY = U(1), U(2)


def _measure(window: int):
    """(rank key, words, digest of the text, digest of the words) of each row."""

    @released
    def run(batches):
        for batch in batches:
            data, at = buffers(batch.column(2))
            n_words, digest, kept = [], [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                text = data[i:j].tobytes()
                words = text.split()
                n_words.append(len(words))
                digest.append(hashlib.blake2b(text, digest_size=16).digest())
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digest, pa.binary()), pa.array(kept)], ["doc_id", "tie", "n_words", "digest", "all_sha256"])

    return run


def _spread(sizes: np.ndarray) -> np.ndarray:
    """0 1 .. sizes[0]-1, 0 1 .. sizes[1]-1, and so on."""
    end = np.cumsum(sizes)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - sizes, sizes)


_PACKET = "part int, chunk long, low binary, high binary, at_low binary, at_high binary, doc_ids binary, ties binary, first binary"


def _probe(block: int, n_parts: int):
    """Packets of every rolling run of `block` words; runs at multiples of it are marked as index. One more row tells a slice's documents."""

    @released
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, words in slices(batch.column(2)):
                chunk += 1
                h = roll(words.hashes(), block)
                size = np.diff(words.first)
                ok = np.maximum(size - block + 1, 0)
                place = _spread(ok)
                at = place + np.repeat(words.first[:-1], ok)
                h = h[at]
                order = np.argsort(h, kind="stable")
                s = h[order]
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                group = np.cumsum(new) - 1
                index = (place % block == 0)[order]
                with_index = np.bincount(group, index, minlength=int(new.sum())) > 0
                many = np.bincount(group, minlength=len(with_index)) > 1
                settled = (with_index & many)[group]
                here = order[settled & ~new]  # they meet a block in this very slice
                send = new | ~settled
                flag = np.where(index | settled, _INDEX, U(0)) | np.where(settled, _MANY, U(0))
                h, at_sent, flag = s[send], at[order][send], flag[send]
                by_place = np.argsort(at_sent, kind="stable")
                h, at_sent, flag = h[by_place], at_sent[by_place], flag[by_place]
                part = part_of(h, n_parts)
                by_part = np.argsort(part, kind="stable")
                part, h, at_sent, flag = (x[by_part] for x in (part, h, at_sent, flag))
                low = h.astype(np.uint32)
                # six more bits of the hash beside two flags; the part holds the top ones
                high = (((mix(h) & U(63)) << U(2)) | flag).astype(np.uint8)
                cuts = np.flatnonzero(np.diff(part)) + 1
                a, b = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(part)]))
                if not len(part):
                    a = b = a[:0]
                col = lambda x, a=a, b=b: [x[p:q].tobytes() for p, q in zip(a, b, strict=True)]
                at_sent = at_sent.astype(np.uint32)
                home = int(chunk % n_parts)
                rows = {
                    "part": part[a].astype(np.int32).tolist() + [home],
                    "chunk": [chunk] * (len(a) + 1),
                    "low": [*col(low), None],
                    "high": [*col(high), None],
                    "at_low": [*col(at_sent.astype(np.uint16)), np.sort(at[here]).astype(np.uint32).tobytes()],
                    "at_high": [*col((at_sent >> 16).astype(np.uint16)), None],
                    "doc_ids": [None] * len(a) + [batch.column(0).slice(i, j - i).to_numpy().tobytes()],
                    "ties": [None] * len(a) + [batch.column(1).slice(i, j - i).to_numpy().tobytes()],
                    "first": [None] * len(a) + [words.first.astype(np.int64).tobytes()],
                }
                yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["chunk"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[2:])], list(rows))

    return run


_MET = "chunk long, at binary, doc_ids binary, ties binary, first binary"


@released
def _meet(batches):
    """Of each hash part: the places, by slice, of probes and blocks that meet one another. Rows on slices pass through."""
    names = ["chunk", "at", "doc_ids", "ties", "first"]
    for rows in runs(batches):
        told = pc.is_null(rows.column("low"))
        for batch in rows.filter(told).select(["chunk", "at_low", "doc_ids", "ties", "first"]).rename_columns(names).to_batches():
            yield batch
        sent = rows.filter(pc.invert(told))
        if sent.num_rows:
            yield from _meet_part(sent, names)


def _meet_part(rows: pa.Table, names: list[str]):
    low, high, at_low, at_high = (joined(rows.column(c), kind) for c, kind in (("low", np.uint32), ("high", np.uint8), ("at_low", np.uint16), ("at_high", np.uint16)))
    sizes, chunk = pc.binary_length(rows.column("high")).to_numpy(), rows.column("chunk").to_numpy()
    key = (low.astype(np.uint64) << U(6)) | (high >> 2)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    flag = high[order]
    n = int(group[-1]) + 1
    ok = (np.bincount(group, flag & 1, minlength=n) > 0) & ((np.bincount(group, minlength=n) > 1) | (np.bincount(group, flag & 2, minlength=n) > 0))
    hit = order[ok[group]]
    source = np.repeat(np.arange(len(sizes)), sizes)[hit]
    at = at_low[hit].astype(np.uint32) | (at_high[hit].astype(np.uint32) << np.uint32(16))
    chunks = chunk[source]
    order = np.lexsort((at, chunks))
    chunks, at = chunks[order], at[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)])) if len(chunks) else np.zeros(1, int)
    for k in range(0, len(cuts) - 1, 1000):
        some = list(zip(cuts[k : k + 1000], cuts[k + 1 : k + 1001], strict=False))
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([int(chunks[a]) for a, _ in some]), pa.array([at[a:b].tobytes() for a, b in some], pa.binary()), none, none, none], names)


def _to_documents(table: pa.Table) -> pa.Table:
    """One slice's meeting places as places in its documents."""
    rows = table.to_pydict()
    out: tuple[list, list, list] = ([], [], [])
    at = np.unique(joined(table.column("at"), np.uint32))
    told = [k for k, x in enumerate(rows["first"]) if x is not None]
    if len(at) and told:
        ids, ties, first = (np.frombuffer(rows[c][told[0]], np.int64) for c in ("doc_ids", "ties", "first"))
        owner = np.searchsorted(first, at, "right") - 1
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d = owner[a]
            out[0].append(int(ids[d]))
            out[1].append(int(ties[d]))
            out[2].append((at[a:b] - first[d]).astype(np.uint32).tobytes())
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "tie": pa.array(out[1], pa.int64()), "anchors": pa.array(out[2], pa.binary())})


_WINDOWS = "part int, ranks binary, counts binary, starts binary, h binary, check binary"


def _windows(window: int, block: int, n_parts: int):
    """Packets of the windows around anchors: of each window, a slice's first place only. Later ones are repeats already and go in rows without hash."""

    @released
    def run(batches):
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ranks = batch.column(0).to_numpy()
            for i, j, words in slices(batch.column(1)):
                hashes = words.hashes()
                h, check = roll(hashes, window), roll(hashes, window, seed=5).astype(np.uint16)
                at, owner = [], []
                for d, anchors in enumerate(batch.column(2).slice(i, j - i).to_pylist()):
                    n = words.first[d + 1] - words.first[d]
                    open_ = np.zeros(max(0, n - window + 1) + 1, np.int32)
                    a = np.frombuffer(anchors, np.uint32).astype(np.int64)
                    lo, hi = np.minimum(np.maximum(a + block - window, 0), len(open_) - 1), np.minimum(a + 1, len(open_) - 1)
                    np.add.at(open_, lo, 1)
                    np.add.at(open_, hi, -1)
                    mine = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
                    at.append(mine + words.first[d])
                    owner.append(np.full(len(mine), d))
                at, owner = np.concatenate(at), np.concatenate(owner)
                if not len(at):
                    continue
                hh, cc = h[at], check[at]
                order = np.lexsort((at, cc, hh))
                new = np.ones(len(at), bool)
                new[1:] = (hh[order][1:] != hh[order][:-1]) | (cc[order][1:] != cc[order][:-1])
                first = np.sort(order[new])
                part = part_of(hh[first], n_parts)
                first = first[np.argsort(part, kind="stable")]
                part = np.sort(part, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
                groups = [(int(part[a]), first[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                later = np.sort(order[~new])
                if len(later):
                    groups.append((int(hh[later[0]] % U(n_parts)), later))
                out = ([], [], [], [], [], [])
                for k, (p, rows) in enumerate(groups):
                    docs, counts = np.unique(owner[rows], return_counts=True)
                    plain = len(later) and k == len(groups) - 1
                    for c, v in zip(out, (p, ranks[i + docs].tobytes(), counts.astype(np.uint32).tobytes(), (at[rows] - words.first[owner[rows]]).astype(np.uint32).tobytes(), None if plain else hh[rows].tobytes(), None if plain else cc[rows].tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["part", "ranks", "counts", "starts", "h", "check"])

    return run


_REPLY = "part int, ranks binary, starts binary"


def _later_places(n_parts: int):
    """Of one hash part: every window but the first of its words, in packets for parts of the documents."""

    def told(rank: np.ndarray, start: np.ndarray):
        part = part_of(mix(rank.view(np.uint64)), n_parts)
        order = np.argsort(part, kind="stable")
        part, rank, start = part[order], rank[order], start[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, int)
        take = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), take(rank), take(start)], ["part", "ranks", "starts"])

    @released
    def run(batches):
        for rows in runs(batches):
            yield from of_part(rows)

    def of_part(rows: pa.Table):
        cols: tuple[list, list, list, list] = ([], [], [], [])
        settled: tuple[list, list] = ([], [])
        for ranks, counts, starts, h, check in zip(*(rows.column(k).to_pylist() for k in range(1, 6)), strict=True):
            rank = np.repeat(np.frombuffer(ranks, np.int64), np.frombuffer(counts, np.uint32))
            start = np.frombuffer(starts, np.uint32)
            if h is None:
                settled[0].append(rank)
                settled[1].append(start)
            else:
                for c, v in zip(cols, (rank, start, np.frombuffer(h, np.uint64), np.frombuffer(check, np.uint16)), strict=True):
                    c.append(v)
        if settled[0]:
            yield from told(np.concatenate(settled[0]), np.concatenate(settled[1]))
        if cols[0]:
            rank, start, h, check = (np.concatenate(c) for c in cols)
            order = np.lexsort((start, rank, check, h))
            again = np.zeros(len(order), bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
            again = order[again]
            yield from told(rank[again], start[again])

    return run


@released
def _gather(batches):
    """Of each part of the documents: (rank, starts) of each document."""
    for rows in runs(batches):
        rank, start = joined(rows.column(1), np.int64), joined(rows.column(2), np.uint32)
        order = np.lexsort((start, rank))
        rank, start = rank[order], start[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(rank)) + 1, [len(rank)])) if len(rank) else np.zeros(1, int)
        for k in range(0, len(cuts) - 1, 1000):
            some = list(zip(cuts[k : k + 1000], cuts[k + 1 : k + 1001], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(rank[a]) for a, _ in some], pa.int64()), pa.array([start[a:b].tobytes() for a, b in some], pa.binary())], ["rank", "starts"])


_CUT = "rank long, n_removed long, kept_sha256 string, kept string"


def _cut(window: int, with_text: bool):
    @released
    def run(batches):
        for batch in batches:
            removed, sha, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.frombuffer(starts, np.uint32)).astype(np.int64)
                change[at] += 1
                np.subtract.at(change, at + window, 1)
                gone = np.cumsum(change)[:-1] > 0
                left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], ["rank", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept_sha256[, kept]) for each row of docs.

    Removed is each word that a window of `window` words covers whose words also start earlier:
    in a smaller doc_id, or in the same document before. Windows are judged on the input.
    kept: the words left, joined by one space; kept is null where no word was removed. A null or empty text
    has no words. A null doc_id comes before all others; different texts under one
    doc_id follow each other by a hash of the text, equal rows share one result. Columns other than doc_id
    and text are ignored. Windows are compared by 80 hash bits.
    """
    if window < 2:
        raise ValueError("window must be 2 or more")
    spark = docs.sparkSession
    store, block = Store(spark, "repeats"), max(1, window // 2)
    own = docs.select(*key_of(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    measured = store.keep(own.mapInArrow(_measure(window), "doc_id long, tie long, n_words long, digest binary, all_sha256 string"), "measured")
    total = measured.agg(F.sum("n_words")).first()[0] or 0
    if not total:
        return _results(docs, measured.withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept_sha256", F.col("all_sha256")).withColumn("kept", F.lit(None).cast("string")), with_text)
    firsts = measured.groupBy("digest").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select("f.doc_id", "f.tie").withColumn("is_first", F.lit(True))
    ordered = measured.select("doc_id", "tie", "n_words", "all_sha256").distinct().join(firsts, ["doc_id", "tie"], "left")
    ranked = store.keep(ordered.orderBy("doc_id", "tie").withColumn("rank", F.monotonically_increasing_id()), "ranked")  # ids rise with the sort
    n_parts = max(parts(spark), total // PART_ENTRIES)
    packets = own.mapInArrow(_probe(block, n_parts), _PACKET)
    met = dealt(packets, n_parts).mapInArrow(_meet, _MET)
    anchors = met.groupBy("chunk").applyInArrow(_to_documents, "doc_id long, tie long, anchors binary")
    # of equal texts only the first is looked at: the others go whole
    wanted = store.keep(anchors.join(ranked.where("is_first").select("doc_id", "tie", "rank"), ["doc_id", "tie"]).dropDuplicates(["rank"]), "anchors")
    near = own.where(might_hold(filter_of(wanted)))
    touched = store.keep(near.dropDuplicates(["doc_id", "tie"]).join(wanted, ["doc_id", "tie"]).select("rank", "text", "anchors"), "touched")
    entries = touched.agg(F.sum(F.length("anchors") / 4)).first()[0] or 0
    w_parts = max(parts(spark), int(entries * block) // PART_ENTRIES)
    windows = touched.select("rank", "text", "anchors").mapInArrow(_windows(window, block, w_parts), _WINDOWS)
    gathered = dealt(dealt(windows, w_parts).mapInArrow(_later_places(w_parts), _REPLY), w_parts).mapInArrow(_gather, "rank long, starts binary")
    cut = touched.select("rank", "text").join(gathered, "rank").mapInArrow(_cut(window, with_text), _CUT)
    whole = (~F.coalesce("is_first", F.lit(False))) & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    told = ranked.join(cut, "rank", "left").select(
        "doc_id", "tie", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
    repeated = measured.groupBy("doc_id", "tie").agg(F.count("*").alias("n"))
    every = told.join(repeated, ["doc_id", "tie"]).withColumn("n", F.explode(F.expr("sequence(1, n)")))
    return _results(docs, every, with_text)


def _results(docs: DataFrame, rows: DataFrame, with_text: bool) -> DataFrame:
    doc_id = F.when(F.col("doc_id") != NEVER, F.col("doc_id"))
    return rows.select(doc_id.alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept", "tie"] if with_text else []))


def without_passages(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs without repeated windows, columns as they were (n_chars, if there, made anew).

    A changed text is its kept words, joined by one space; a document of which nothing is left goes. Others stay as they
    are, null and empty texts among them; equal rows are cut alike and all stay.
    """
    store = Store(docs.sparkSession, "passages")
    cut = remove_repeats(docs, window, with_text=True).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(NEVER)).alias("doc_id"), "tie", "kept").dropDuplicates(["doc_id", "tie"])
    whole, touched, (_, _, kept) = met(docs, store.keep(cut, "cut"), "kept")
    columns = [F.coalesce(F.col(kept), F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = whole.unionByName(touched.where(F.coalesce(F.col(kept) != "", F.lit(True))).select(*columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
