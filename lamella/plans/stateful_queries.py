"""Queries on work queues, generations and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scheduling
from .catalog import query, table

_AGED = "CAST(substr(o_orderpriority, 1, 1) AS INT) - least((o_orderkey * 7 % 1000) // 200, 3)"


@query(f"SELECT o_custkey, o_orderkey, CAST({_AGED} AS INT) AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY {_AGED}, o_totalprice DESC, o_orderkey) AS dispatch FROM orders")
def scheduling_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = scheduling.aged_priority(F.substring("o_orderpriority", 1, 1).cast("int"), F.col("o_orderkey") * 7 % 1000, 200, 3)
    o = table(spark, sf_dir, "orders").withColumn("key", key)
    return o.select("o_custkey", "o_orderkey", "key", F.row_number().over(Window.partitionBy("o_custkey").orderBy("key", F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("dispatch"))


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props, min(event_id) AS enqueued, count(*) AS n_submitted FROM events GROUP BY ALL")
def coalesced_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduling.coalesced(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "props")


_GEN = "CAST(day(ts) AS INT) - event_id % 3"


@query(f"""
    WITH g AS (SELECT user_id, event_id, CAST({_GEN} AS BIGINT) AS generation, max({_GEN}) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events)
    SELECT user_id, event_id, generation FROM g WHERE generation >= seen""")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.dayofmonth("ts") - F.col("event_id") % 3).cast("long").alias("generation"))
    return scheduling.gated(e, "user_id", "event_id", "generation")


@query("""
    WITH s AS (SELECT c_custkey AS session, max(o_orderkey) // 100 AS current, c_custkey % 10 = 0 AS closed FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 7 <> 0 GROUP BY c_custkey)
    SELECT o_custkey AS session, o_orderkey, CASE WHEN current IS NULL THEN 'discard-unknown-session' WHEN closed THEN 'discard-closed' WHEN o_orderkey // 100 < current THEN 'discard-stale' ELSE 'publish' END AS decision
    FROM orders LEFT JOIN s ON s.session = o_custkey""")
def stale_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session"), "o_orderkey", F.floor(F.col("o_orderkey") / 100).alias("generation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session")).where("session % 7 <> 0")
    s = o.join(c, "session", "left_semi").groupBy("session").agg(F.max("generation").alias("current")).withColumn("closed", F.col("session") % 10 == 0)
    return scheduling.arbitrate(o, s, "session", "generation").select("session", "o_orderkey", "decision")


@query("""
    WITH a AS (SELECT user_id, event_id, CAST(round(value) AS BIGINT) % 12 AS k, lag(event_id) OVER (PARTITION BY user_id, CAST(round(value) AS BIGINT) % 12 ORDER BY event_id) AS before FROM events),
         d AS (SELECT a.user_id, a.event_id, count(DISTINCT b.k) AS between_keys FROM a LEFT JOIN a b ON b.user_id = a.user_id AND b.event_id > a.before AND b.event_id < a.event_id GROUP BY ALL)
    SELECT a.user_id, a.event_id, a.before IS NOT NULL AND d.between_keys < 5 AS hit FROM a JOIN d USING (user_id, event_id)""")
def lru_cache_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.round("value").cast("long") % 12).alias("k"), F.lit(1).alias("w"))
    return scheduling.lru(e, "user_id", "event_id", "k", "w", 5, 1 << 30).select("user_id", "event_id", "hit")


@query()
def lru_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 17).alias("k"), (F.col("event_id") * 31 % 17 * 10 + 5).alias("w"))
    return scheduling.lru(e, "user_id", "event_id", "k", "w", 8, 400)


@query("""
    WITH q AS (SELECT o_custkey % 20 AS worker, o_custkey AS session, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS turn, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders)
    SELECT worker, session, o_orderkey, turn, row_number() OVER (PARTITION BY worker ORDER BY turn, first, session, o_orderkey) AS position FROM q""")
def fair_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("worker"), F.col("o_custkey").alias("session"), "o_orderkey")
    out = scheduling.fair_order(q, "worker", "session", "o_orderkey", 3)
    return out.withColumn("position", F.col("position").cast("long"))


@query("""
    SELECT 'orders' AS child, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
    UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def foreign_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lost = lambda name, child, parent, on: child.join(parent, on, "left_anti").agg(F.lit(name).alias("child"), F.count("*").alias("n"))
    a = lost("orders", t("orders"), t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    b = lost("customer", t("customer"), t("nation").where("n_regionkey <> 2"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = lost("labels", t("labels").select("doc_id"), t("documents").where("lang = 'en'").select("doc_id"), "doc_id")
    return a.union(b).union(c)


_PART = "CAST(CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS HUGEINT) * 10000 // 18446744073709551616 < 2000"


@query(f"SELECT md5(text) AS content, count(*) FILTER ({_PART}) AS n_holdout, count(*) FILTER (NOT ({_PART})) AS n_tuning FROM documents GROUP BY 1 HAVING n_holdout > 0 AND n_tuning > 0")
def holdout_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.expr("cast(conv(substring(sha2(cast(doc_id as string), 256), 1, 16), 16, 10) as decimal(20,0)) * 10000 div 18446744073709551616 < 2000")
    d = table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content")).agg(F.count_if(held).alias("n_holdout"), F.count_if(~held).alias("n_tuning"))
    return d.where("n_holdout > 0 and n_tuning > 0")


@query("""
    SELECT p_brand, count(*) AS total, count(*) FILTER (p_size <= 10) AS missing, count(*) FILTER (p_size <= 10) = 0 AS supported, array_to_string(list_sort(list(p_partkey) FILTER (p_size <= 10))[1:5], ',') AS contributors,
           CASE WHEN count(*) FILTER (p_size <= 10) > 5 THEN 'truncated' ELSE 'complete' END AS completeness FROM part GROUP BY p_brand""")
def capability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("p_size") <= 10
    # ranked first, so only the five that are kept are gathered
    p = table(spark, sf_dir, "part").withColumn("low", low).withColumn("k", F.row_number().over(Window.partitionBy("p_brand", "low").orderBy("p_partkey")))
    n = F.count_if("low")
    out = p.groupBy("p_brand").agg(F.count("*").alias("total"), n.alias("missing"), (n == 0).alias("supported"), F.array_sort(F.collect_list(F.when(F.col("low") & (F.col("k") <= 5), F.col("p_partkey")))).alias("c"))
    return out.select("p_brand", "total", "missing", "supported", F.when(F.size("c") > 0, F.array_join(F.transform("c", lambda x: x.cast("string")), ",")).alias("contributors"), F.when(F.col("missing") > 5, "truncated").otherwise("complete").alias("completeness"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"))


@query()
def remembered_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch order with a memory of turns; a session may run ahead by four turns at most."""
    q = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("worker"), F.col("o_custkey").alias("session"), (F.col("o_orderkey") * 37 % 5).alias("priority"), "o_orderkey")
    return scheduling.dispatched(q, "worker", "session", ["priority", "o_orderkey"], 4)
