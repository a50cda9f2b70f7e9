"""Positional and multiset differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def section_diff(expected: DataFrame, actual: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Counts, changed, missing and unexpected elements and the first difference of each keyed list. An index is there once in a list.

    Sides that are dealt by their keys alike meet in the tasks where they are.
    """
    side = lambda d, mine: d.select(*keys, index, F.col(value).alias("_v"), F.lit(mine).alias("_mine"))
    both = side(expected, True).unionAll(side(actual, False))
    own = lambda mine: F.max(F.when(F.col("_mine") == mine, F.col("_v")))
    has = lambda mine: F.max(F.when(F.col("_mine") == mine, 1))
    joined = both.groupBy(*keys, index).agg(own(True).alias("_e"), own(False).alias("_a"), has(True).alias("_he"), has(False).alias("_ha"))
    changed = F.col("_he").isNotNull() & F.col("_ha").isNotNull() & ~F.col("_e").eqNullSafe(F.col("_a"))
    missing, extra = F.col("_ha").isNull(), F.col("_he").isNull()
    return joined.groupBy(*keys).agg(F.count("_he").alias("n_expected"), F.count("_ha").alias("n_actual"), F.count_if(changed).alias("changed"), F.count_if(missing).alias("missing"), F.count_if(extra).alias("unexpected"), F.min(F.when(changed | missing | extra, F.col(index))).alias("first_difference"))


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows with how many more (positive) or fewer times they are in actual than in expected."""
    both = expected.withColumn("_d", F.lit(-1)).unionByName(actual.withColumn("_d", F.lit(1)))
    return both.groupBy(*expected.columns).agg(F.sum("_d").alias("delta")).where("delta <> 0")


def pixel_diff(pixels: DataFrame, key: str, native: str, baseline: str) -> DataFrame:
    """Of two RGBA buffers a row: differing pixels and channels, largest difference by channel, and their sum."""
    byte = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(c, i, F.lit(1))), 16, 10).cast("int"))
    delta = F.zip_with(byte(F.col(native)), byte(F.col(baseline)), lambda a, b: F.abs(a - b))
    out = pixels.select(key, delta.alias("d"))
    channel = lambda c: F.array_max(F.filter("d", lambda _, i: i % 4 == c))
    return out.select(
        key,
        F.expr("size(filter(sequence(0, size(d) div 4 - 1), p -> exists(slice(d, p * 4 + 1, 4), x -> x > 0)))").cast("long").alias("pixels"),
        F.expr("size(filter(d, x -> x > 0))").cast("long").alias("channels"),
        *(channel(k).cast("long").alias(f"max_{n}") for k, n in enumerate("rgba")),
        F.expr("aggregate(d, 0L, (s, x) -> s + x)").alias("total"),
    )
