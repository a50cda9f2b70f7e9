"""Generic Spark queries: these have no counterpart in the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, table

_C = "CAST(round({0} * 100) AS BIGINT)"


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum({_C.format('l_extendedprice')}) AS BIGINT) AS base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def generic_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.sum(_cents("l_extendedprice")).alias("base"), F.count("*").alias("n"))


@query(f"SELECT o_orderkey, o_orderpriority, CAST(sum({_C.format('l_extendedprice')}) AS BIGINT) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")
def generic_shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _cents("l_extendedprice").alias("c"))  # noqa: E741
    return o.join(l, "o_orderkey").groupBy("o_orderkey", "o_orderpriority").agg(F.sum("c").alias("revenue"))


@query(f"SELECT r_name, n_name, count(*) AS customers, CAST(sum({_C.format('c_acctbal')}) AS BIGINT) AS balance, grouping(r_name) AS g_region, grouping(n_name) AS g_nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def generic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(_cents("c_acctbal")).alias("balance"), F.grouping("r_name").cast("long").alias("g_region"), F.grouping("n_name").cast("long").alias("g_nation"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def generic_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT e.event_id, arg_max(o.o_orderkey, o.o_orderkey) AS o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id GROUP BY e.event_id")
def generic_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of the user at or before each event: one sort of both sides together, no pairs."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), F.col("event_id"), F.lit(None).cast("long").alias("o"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("o"))
    w = Window.partitionBy("k").orderBy("at", F.col("event_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(o).withColumn("o_orderkey", F.last("o", ignorenulls=True).over(w))
    return both.where("event_id is not null and o_orderkey is not null").select("event_id", "o_orderkey")
