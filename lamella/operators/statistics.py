"""Exact nearest-rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(n: Column, percent: int) -> Column:
    """1-based rank of a percentile among n sorted samples, in whole numbers: the ceiling of n * percent / 100."""
    return F.floor((n * percent + 99) / 100).cast("long")


def sample_summary(samples: DataFrame, keys: list[str], value: str, minimum: int) -> DataFrame:
    """count, min, p50, p95, p99, max of a whole-number column by keys, and whether there are `minimum` samples.

    Equal values are counted before anything is sorted, so a group's window holds its distinct values only.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_k").over(upto)).withColumn("_n", F.sum("_k").over(whole))
    at = {f"p{p}": F.min(F.when(F.col("_upto") >= nearest_rank(F.col("_n"), p), F.col(value))).alias(f"p{p}") for p in (50, 95, 99)}
    out = ranked.groupBy(*keys).agg(F.sum("_k").alias("n"), F.min(value).alias("min_v"), *at.values(), F.max(value).alias("max_v"))
    return out.withColumn("adequacy", F.when(F.col("n") < minimum, "insufficient").otherwise("meets-configured-minimum"))


def ratio(native: Column, baseline: Column, scale: int = 10_000) -> Column:
    """native / baseline in parts of `scale`, rounded down; null where the baseline is zero."""
    return F.when(baseline != 0, F.floor(native.cast("decimal(28,0)") * scale / baseline.cast("decimal(28,0)")).cast("long"))
