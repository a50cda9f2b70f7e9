"""Versions of objects and references among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


def latest_wins(rows: DataFrame, keys: list[str], version: list[str], payload: list[str], tombstone) -> DataFrame:
    """The newest row of each key; a tombstone hides what is older and is then left out."""
    newest = F.max_by(F.struct(*payload, tombstone.alias("_gone")), F.struct(*version)).alias("_r")
    return rows.groupBy(*keys).agg(newest).where("not _r._gone").select(*keys, *(f"_r.{c}" for c in payload))


def conflicting_identity(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Keys under which more than one content is found."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.countDistinct(content).alias("n_contents")).where("n_contents > 1")


def follow_references(refs: DataFrame, limit: int) -> DataFrame:
    """(id, hops, last, outcome) of each row of refs (id, next: null at a value): resolved, cycle, missing or depth, after at most limit hops.

    A round is one join of the ways that still go on, each written and read again.
    """
    refs = kept(refs)
    there = refs.select(F.col("id").alias("_to"), F.col("next").alias("_then"), F.lit(True).alias("_known")).hint("merge")
    ended = []
    going = refs.select("id", F.lit(0).alias("hops"), F.col("id").alias("at"), "next", F.array("id").alias("path"))
    for hops in range(limit + 1):
        known = F.when(F.col("next").isNull(), "resolved").when(F.array_contains("path", F.col("next")), "cycle")
        told = going.withColumn("outcome", known)
        # what has ended does not meet in the join, where all nulls would be one key
        step = told.where("outcome is null").join(there, F.col("next") == F.col("_to"), "left")
        step = kept(step.withColumn("outcome", F.when(F.col("_known").isNull(), "missing").when(F.lit(hops == limit), "depth")))
        ended += [x.where("outcome is not null").select("id", "hops", F.col("at").alias("last"), "outcome") for x in (told, step)]
        going = step.where("outcome is null").select("id", (F.col("hops") + 1).alias("hops"), F.col("next").alias("at"), F.col("_then").alias("next"), F.concat("path", F.array("next")).alias("path"))
        if going.isEmpty():
            break
    out = reduce(DataFrame.unionAll, ended)
    # an id of several rows has several ways: the longest counts
    return out.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("hops")))).where("_k = 1").drop("_k")
