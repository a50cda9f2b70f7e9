"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store

SLOTS, PLACES = 8192, 16


@dataclass(frozen=True)
class SlotMap:
    """owner[slot] is the shard of a virtual slot; every edit makes the next version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    def rebalanced(self, size: dict[int, int], shards: int | None = None, tolerance: float = 0.002) -> SlotMap:
        """Move slots from the fullest to the emptiest shards until none is over the mean by more than tolerance; slots of shards that went move all."""
        shards = shards or self.shards
        owner, load = list(self.owner), [0] * shards
        kept: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        loose = []
        for slot, shard in enumerate(owner):
            if shard < shards:
                kept[shard].append((size.get(slot, 0), slot))
                load[shard] += size.get(slot, 0)
            else:
                loose.append((size.get(slot, 0), slot))
        mean = sum(size.values()) / shards
        for shard in range(shards):
            kept[shard].sort()
            while kept[shard] and load[shard] > mean * (1 + tolerance):
                n, slot = kept[shard].pop()
                if not n:
                    break
                loose.append((n, slot))
                load[shard] -= n
        heap = [(n, shard) for shard, n in enumerate(load)]
        heapq.heapify(heap)
        for n, slot in sorted(loose, reverse=True):
            least, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (least + n, shard))
        return SlotMap(self.version + 1, shards, tuple(owner))

    @staticmethod
    def balanced(size: dict[int, int], shards: int, slots: int = SLOTS) -> SlotMap:
        """The first version: slots by falling size, each to the shard with the least so far."""
        return SlotMap(0, 0, (slots,) * slots).rebalanced(size, shards)

    def write(self, spark: SparkSession, folder: str) -> None:
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.owner)]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int").coalesce(1).write.parquet(f"{folder}/version={self.version:08d}")

    @staticmethod
    def read(spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version:08d}").select("shards", "slot", "shard").orderBy("slot").collect()
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row; the text itself goes no further than its scan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32")).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """One row (doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot) for each row of docs, under the law ``bytes``.

    Rows hash by doc_id and text into ``slots`` virtual slots; the slots' bytes
    (at most ``slots`` sums) give the map, which is stored as version 1 in ``folder``
    (by default beside the other kept tables). size: UTF-8 bytes and 1, null counting as empty.
    slot: the row's place in its shard, without gaps from 0, rows of a virtual slot being
    ordered by doc_id. Null ids hash like a value; repeated rows share a virtual slot.
    """
    spark = docs.sparkSession
    store = Store(spark, "sharding")
    rows = store.keep(slotted(docs, slots), "slotted")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("size", "text_crc32", "doc_id", F.lit(7)), F.lit(PLACES)).cast("int"))
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("size")).collect()  # at most `slots` rows
    slot_map = SlotMap.balanced({r["vslot"]: r["size"] for r in sums}, shards, slots)
    slot_map.write(spark, folder or f"{store.root}/map")
    owner = spark.createDataFrame(list(enumerate(slot_map.owner)), "vslot int, shard int")
    counts = rows.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(F.broadcast(owner), "vslot")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")).select("vslot", "part", "shard", "before")
    own = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("own", own).join(F.broadcast(before), ["vslot", "part"])  # at most slots * PLACES rows
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot")
