"""Components of the links among nodes that share buckets, without writing out all pairs of a bucket.

A bucket only proposes pairs; a test decides them. Round 0 tests each bucket's
smallest node, its hub, against the others; buckets with one hub are one there.
Whatever is then in one component needs no further test. Later rounds
look at buckets that still hold several components and test growing numbers
of hubs, taken from outside a bucket's largest component, against members of other
components. A hub has met all of its bucket and leaves it, so the rounds
end when every proposed pair lies inside a component or has been tested: no
link that could join two components is lost, and no bucket is ever gathered.

Members of large buckets are dealt in blocks, hubs likewise; a task holds one
block's hubs and streams the members past them. Where nodes have sketches, these
are compared first, and contents go only to the blocks where a sketch says that a pair is likely.
Of sketches and contents a filter lets those into a round's shuffle that its rows may ask for.
Where tests are dear, a pair that shares several buckets is tested in one of them: rows
carry the smallest keys of their node, and a pair with a common key below the bucket's own is left to that one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .packets import filter_of, might_hold
from .store import Store
from .text import released

FIRST_HUBS, MORE_HUBS, HUB_BLOCK, BLOCK_ROWS = 64, 16, 1024, 2048
#: So many asked pairs are tested together, so many keys looked at together.
TOGETHER, KEYS_AT_ONCE = 20_000, 512
#: Takes (contents of hubs, contents of members, which pairs (hub, member) to test) of some blocks; tells which of these pass.
Block = tuple[list, list, np.ndarray]
Test = Callable[[list[Block]], list[np.ndarray]]


class _Rows:
    """Some rows (key, hubs' block, members' block, node, component, hub, content, own keys) of one block."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        self.place = tuple(table.column(k)[0].as_py() for k in range(3))
        self.node, self.c = (table.column(k).to_numpy() for k in (3, 4))
        self.content = table.column(6).to_pylist()
        keys = table.column(7).combine_chunks() if table.num_columns > 7 else None
        self.keys = (keys.flatten().to_numpy(), np.repeat(np.arange(len(keys)), pc.list_value_length(keys).fill_null(0).to_numpy(zero_copy_only=False))) if keys is not None else None


def _elsewhere(hubs: _Rows, members: _Rows) -> np.ndarray:
    """Which pairs (hub, member) have a common key below that of their bucket."""
    out = np.zeros((len(hubs.node), len(members.node)), bool)
    (h, of_h), (m, of_m) = hubs.keys, members.keys
    common = np.intersect1d(h[h < hubs.place[0]], m)
    for k in range(0, len(common), KEYS_AT_ONCE):
        some, has = common[k : k + KEYS_AT_ONCE], []
        for keys, of, n in ((h, of_h, out.shape[0]), (m, of_m, out.shape[1])):
            at = np.minimum(np.searchsorted(some, keys), len(some) - 1)
            ok = some[at] == keys
            x = np.zeros((n, len(some)), np.float32)
            x[of[ok], at[ok]] = 1
            has.append(x)
        out |= has[0] @ has[1].T > 0
    return out


def _met(batches) -> Iterator[tuple[_Rows, _Rows]]:
    """(hubs, members) of blocks in sorted rows, hubs before members; a block's members come in runs of a batch."""
    last, found, hubs = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 5)]
        change = np.zeros(batch.num_rows - 1, bool)
        for x in head:
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            place = tuple(x[a] for x in head[:3])
            if place != last:
                last, found, hubs = place, [], None
            rows = batch.slice(a, b - a)
            if head[3][a]:
                found.append(rows)
            elif found:
                hubs = hubs or _Rows(found)
                yield hubs, _Rows([rows])


def _tested(batches, test: Test) -> Iterator[tuple[_Rows, _Rows, np.ndarray]]:
    """(hubs, members, which pairs pass) of blocks, pairs of unlike components alone being asked."""
    waiting, asked = [], 0

    def done():
        answers = test([(h.content, m.content, ok) for h, m, ok in waiting])
        return [(h, m, ok) for (h, m, _), ok in zip(waiting, answers, strict=True) if ok.any()]

    for hubs, members in _met(batches):
        ok = hubs.c[:, None] != members.c
        if hubs.keys is not None and ok.any():
            ok &= ~_elsewhere(hubs, members)
        if ok.any():
            waiting.append((hubs, members, ok))
            asked += int(ok.sum())
        if asked >= TOGETHER:
            yield from done()
            waiting, asked = [], 0
    if waiting:
        yield from done()


def _likely(test: Test):
    """Rows (key, hubs' block, members' block, node, c, hub) of hubs and members in pairs that pass; a hub once for each run of members."""

    @released
    def run(batches):
        for hubs, members, ok in _tested(batches, test):
            h, m = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            n = len(h) + len(m)
            key, i, j = hubs.place
            places = [np.full(n, key), np.full(n, i, np.int32), np.full(n, j, np.int32)]
            own = [np.concatenate((hubs.node[h], members.node[m])), np.concatenate((hubs.c[h], members.c[m])), np.arange(n) < len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in places + own], ["key", "i", "j", "node", "c", "hub"])

    return run


def _links(test: Test):
    @released
    def run(batches):
        for hubs, members, ok in _tested(batches, test):
            h, m = np.nonzero(ok)
            x, y = hubs.node[h], members.node[m]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def _dealt(active: DataFrame, is_hub: Column, hub_blocks: Column, blocks: Column) -> DataFrame:
    """Rows (key, i, j, node, c, hub) of active rows: as a member in its own block of members, for every block of hubs; as a hub the other way round."""
    none = F.expr("cast(array() as array<struct<i: int, j: int, hub: boolean>>)")
    own_i, own_j = (F.pmod(F.xxhash64("node", F.lit(k)), b).cast("int") for k, b in ((1, hub_blocks), (2, blocks)))
    as_member = F.transform(F.sequence(F.lit(0), hub_blocks - 1), lambda i: F.struct(i.alias("i"), own_j.alias("j"), F.lit(False).alias("hub")))
    as_hub = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(own_i.alias("i"), j.alias("j"), F.lit(True).alias("hub")))
    places = F.concat(as_member, F.when(is_hub, as_hub).otherwise(none))
    return active.select("key", "node", "c", F.explode(places).alias("p")).select("key", "p.i", "p.j", "node", "c", "p.hub")


def _blocks(n: Column, rows: int) -> Column:
    return F.ceil(n / rows).cast("int")


def link(store: Store, buckets: DataFrame, content: DataFrame, test: Test, sketch: DataFrame | None = None, likely: Test | None = None, once: int = 0, links: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that links join.

    buckets: kept table (key, node), rows distinct, each key with two nodes or more.
    content: kept table (node, content) for test, which decides pairs.
    sketch: kept table (node, content) for likely, which must pass every pair that test passes.
    once: rows of later rounds carry so many of their node's keys, the smallest. A pair is tested in the bucket of
    the first common one among them; without one, in each of its buckets.
    links: known links (a, b), which count beside those found.
    """
    own_keys: DataFrame | None = None

    def decided(rows: DataFrame, nodes: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The links among rows; nodes: a kept table of all their nodes, if they are not those of all buckets."""

        def meet(rows: DataFrame, of: DataFrame, nodes: DataFrame | None, run, schema: str) -> DataFrame:
            if nodes is not None:
                of = of.where(might_hold(filter_of(nodes, F.xxhash64("node")), "node"))
            full = rows.join(of, "node") if keys is None else rows.join(of, "node").join(keys, "node")
            full = full.select("key", "i", "j", "node", "c", "hub", "content", *["keys"] * (keys is not None))
            return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("hub")).mapInArrow(run, schema).distinct()

        some = None
        if sketch is not None:
            rows = nodes = some = store.keep(meet(rows, sketch, nodes, _likely(likely), "key long, i int, j int, node long, c long, hub boolean"), "likely")
        out = store.keep(meet(rows, content, nodes, _links(test), "a long, b long"), "links")
        if some is not None:
            store.drop(some)
        return out

    hub = buckets.groupBy("key").agg(F.min("node").alias("hub"))
    starred = store.keep(buckets.join(hub, "key").where("node <> hub").select("key", "node", "hub"), "stars")
    pairs = starred.select(F.col("hub").alias("key"), "node").distinct()
    size = pairs.groupBy("key").agg(F.count("*").alias("n"))
    own = size.select("key", F.col("key").alias("node"), "n")
    star = pairs.join(size, "key").select("key", "node", "n").unionByName(own).withColumn("c", F.col("node"))
    first = decided(_dealt(star, F.expr("node = key"), F.lit(1), _blocks(F.col("n"), BLOCK_ROWS)))
    found, rest, hubs, round_no = components(store, first if links is None else first.unionByName(links)), starred.select("key", "node"), FIRST_HUBS, 1
    while True:
        member = rest.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        each = member.groupBy("key", "c").agg(F.count("*").alias("n"))
        state = each.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("several")).where("several > 1")
        active = store.keep(member.join(state.select("key", "n", F.col("top.c").alias("top"), (F.col("n") - F.col("top.n")).alias("others")), "key"), "active")
        if active.isEmpty():
            return found
        is_hub = F.expr(f"c <> top and pmod(xxhash64(node, {round_no}), greatest(1, others div {hubs})) = 0")
        rows = _dealt(active, is_hub, _blocks(F.least(F.col("others"), F.lit(2 * hubs)), HUB_BLOCK), _blocks(F.col("n"), BLOCK_ROWS))
        if once:
            if own_keys is None:
                own_keys = store.keep(starred.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, once).alias("keys")), "keys")
        good = decided(rows, active, own_keys)
        if not good.isEmpty():
            stars = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
            found = components(store, stars.unionByName(good))
        rest = active.where(~is_hub).select("key", "node")
        hubs, round_no = hubs * MORE_HUBS, round_no + 1
