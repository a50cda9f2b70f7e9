"""Half-open ranges: merging, gaps, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt


def _islands(ranges: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt(ranges, ranges, *keys)
    # ranges merge if they overlap or lie closer than the gap; at the gap itself they stay apart
    new = F.when(before.isNull() | ~((F.col(start) < before) | (F.col(start) - before < gap)), 1).otherwise(0)
    return ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def coalesce_ranges(ranges: DataFrame, keys: list[str], start: str, end: str, priority: str, gap: int) -> DataFrame:
    """Merged ranges with the number of requests, their bytes and the highest priority."""
    return _islands(ranges, keys, start, end, gap).groupBy(*keys, "_island").agg(F.min(start).alias("merged_start"), F.max(end).alias("merged_end"), F.count("*").alias("n_requests"), F.sum(F.col(end) - F.col(start)).alias("requested"), F.max(priority).alias("priority")).drop("_island")


def gaps(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What lies between the merged ranges of each key."""
    merged = coalesce_ranges(ranges.withColumn("_p", F.lit(0)), keys, start, end, "_p", 1)
    following = F.lead("merged_start").over(Window.partitionBy(*keys).orderBy("merged_start"))
    return merged.select(*keys, F.col("merged_end").alias("gap_start"), following.alias("gap_end")).where("gap_end > gap_start")


def physical_intervals(offsets: DataFrame, keys: list[str], offset: str, last: int) -> DataFrame:
    """Each offset with the next one of its key as its end; the last ends at `last`."""
    return offsets.withColumn("interval_end", F.lead(offset, 1, last).over(Window.partitionBy(*keys).orderBy(offset)))


def assign_ranges(children: DataFrame, parent: str, order: str, size: str) -> DataFrame:
    """Start and end of every child in its parent's sequence, from the sizes of those before it."""
    before = F.sum(size).over(Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return children.withColumn("range_start", F.coalesce(before, F.lit(0)).cast("long")).withColumn("range_end", F.col("range_start") + F.col(size))


def containing_segment(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The deepest segment (seg, seg_start, seg_end, depth) of its key that holds each point (point)."""
    met = points.join(segments, key).where("point >= seg_start and point < seg_end")
    return met.groupBy(key, "point").agg(F.max_by("seg", F.struct("depth", "seg")).alias("seg"), F.max("depth").alias("depth"))
