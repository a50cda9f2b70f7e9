"""Order-dependent queries: intervals, stacks, running state, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals
from .catalog import query, table

_RANGES = "SELECT l_suppkey, l_partkey * 12 AS s, l_partkey * 12 + CAST(l_quantity AS BIGINT) AS e, l_linenumber AS p FROM lineitem"
_ISLANDS = f"""r AS ({_RANGES}), m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 12).alias("s"), (F.col("l_partkey") * 12 + F.col("l_quantity").cast("long")).alias("e"), F.col("l_linenumber").alias("p"))


@query(f"""
    WITH {_ISLANDS}, g AS (SELECT *, sum(CASE WHEN before IS NULL OR NOT (s < before OR s - before < 5) THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT l_suppkey, min(s) AS merged_start, max(e) AS merged_end, count(*) AS n_requests, CAST(sum(e - s) AS BIGINT) AS requested, max(p) AS priority FROM g GROUP BY l_suppkey, island""")
def coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce_ranges(_ranges(spark, sf_dir), ["l_suppkey"], "s", "e", "p", 5)


@query(f"SELECT l_suppkey, before AS gap_start, s AS gap_end FROM (WITH {_ISLANDS} SELECT * FROM m) WHERE s > before")
def missing_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(_ranges(spark, sf_dir), ["l_suppkey"], "s", "e")


@query("SELECT o_custkey, o_orderkey, lead(o_orderkey, 1, 100000000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS interval_end FROM orders")
def xref_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.physical_intervals(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 100_000_000).withColumn("interval_end", F.col("interval_end").cast("long"))


_PAGES = "k AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), a AS (SELECT *, CAST(coalesce(sum(pages) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS range_start FROM k)"


def _page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"))
    k = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(n, "o_orderkey", "left").withColumn("pages", F.coalesce("pages", F.lit(0)).cast("long"))
    return intervals.assign_ranges(k, "o_custkey", "o_orderkey", "pages")


@query(f"WITH {_PAGES} SELECT o_custkey, o_orderkey, pages, range_start, range_start + pages AS range_end FROM a")
def page_range_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_ranges(spark, sf_dir)


@query(f"""
    WITH {_PAGES}, seg AS (SELECT o_custkey, o_orderkey AS seg, range_start AS a, range_start + pages AS b, 1 AS depth FROM a UNION ALL SELECT o_custkey, -1, 0, CAST(sum(pages) AS BIGINT), 0 FROM k GROUP BY o_custkey),
    p AS (SELECT c_custkey AS o_custkey, c_custkey % 37 AS point FROM customer), m AS (SELECT o_custkey, point, seg, depth, row_number() OVER (PARTITION BY o_custkey, point ORDER BY depth DESC, seg DESC) AS r FROM p JOIN seg USING (o_custkey) WHERE point >= a AND point < b)
    SELECT o_custkey, point, seg, depth FROM m WHERE r = 1""")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _page_ranges(spark, sf_dir)
    leaf = pages.select("o_custkey", F.col("o_orderkey").alias("seg"), F.col("range_start").alias("seg_start"), F.col("range_end").alias("seg_end"), F.lit(1).alias("depth"))
    root = pages.groupBy("o_custkey").agg(F.sum("pages").alias("seg_end")).select("o_custkey", F.lit(-1).cast("long").alias("seg"), F.lit(0).cast("long").alias("seg_start"), "seg_end", F.lit(0).alias("depth"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 37).alias("point"))
    return intervals.containing_segment(points, leaf.unionByName(root), "o_custkey")


_STEP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END"


@query(f"""
    WITH d AS (SELECT user_id, event_id, {_STEP} AS step, sum({_STEP}) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM events)
    SELECT user_id, CAST(min(depth) AS BIGINT) AS lowest, CAST(max(depth) AS BIGINT) AS highest, CAST(sum(step) AS BIGINT) AS final, CASE WHEN min(depth) < 0 THEN 'underflow' WHEN sum(step) <> 0 THEN 'unclosed' ELSE 'balanced' END AS outcome FROM d GROUP BY user_id""")
def balanced_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_STEP).cast("long").alias("step"))
    d = e.withColumn("depth", F.sum("step").over(Window.partitionBy("user_id").orderBy("event_id")))
    outcome = F.when(F.min("depth") < 0, "underflow").when(F.sum("step") != 0, "unclosed").otherwise("balanced")
    return d.groupBy("user_id").agg(F.min("depth").alias("lowest"), F.max("depth").alias("highest"), F.sum("step").alias("final"), outcome.alias("outcome"))


@query("""
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS state, row_number() OVER w - 1 AS ordinal, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS advance
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("state"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("ordinal"), F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("advance"))


@query("""
    WITH f AS (SELECT o_custkey, l_suppkey % 10 AS resource, min(o_orderkey * 10 + l_linenumber) AS first_use, count(*) AS uses FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_custkey, resource, uses, rank() OVER (PARTITION BY o_custkey ORDER BY first_use, resource) - 1 AS resource_id FROM f""")
def first_use_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = joined.groupBy("o_custkey", (F.col("l_suppkey") % 10).alias("resource")).agg(F.min(F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("first_use"), F.count("*").alias("uses"))
    return f.select("o_custkey", "resource", "uses", (F.rank().over(Window.partitionBy("o_custkey").orderBy("first_use", "resource")) - 1).cast("long").alias("resource_id"))


@query("""
    WITH s AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 1 ELSE lag(o_orderkey) OVER w END AS prev, lag(o_orderkey) OVER w AS expected FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT o_custkey, o_orderkey, prev, expected FROM s WHERE prev IS DISTINCT FROM expected""")
def sibling_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", expected.alias("expected"))
    s = s.withColumn("prev", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey") - 1).otherwise(F.col("expected")))
    return s.where(~F.col("prev").eqNullSafe(F.col("expected"))).select("o_custkey", "o_orderkey", "prev", "expected")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS is_permutation, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def permutation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(((F.count("*") == F.countDistinct(n)) & (F.min(n) == 1) & (F.max(n) == F.count("*"))).alias("is_permutation"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_size + unnest(range(0, p_size % 5 + 1)) AS code, p_partkey % 100 + 500 AS width FROM part")
def width_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.sequence(F.col("p_size").cast("long"), (F.col("p_size") + F.col("p_size") % 5).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(codes).alias("code"), (F.col("p_partkey") % 100 + 500).alias("width"))


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS len, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, (upto - len) % 14 AS phase, upto // 14 - (upto - len) // 14 AS dashes, (upto - len) % 14 < 9 AS starts_on FROM s""")
def dash_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, sf_dir, "lineitem").withColumn("len", F.col("l_quantity").cast("long")).withColumn("upto", F.sum("len").over(order))
    before = F.col("upto") - F.col("len")
    return s.select("l_orderkey", "l_linenumber", "l_partkey", (before % 14).alias("phase"), (F.floor(F.col("upto") / 14) - F.floor(before / 14)).alias("dashes"), (before % 14 < 9).alias("starts_on"))


@query("SELECT conv_id, turn, octet_length(encode(text)) AS n_bytes, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(regexp_extract_all(text, '[A-Za-z]+')) AS names, md5(array_to_string(regexp_extract_all(text, '[0-9]+|[A-Za-z]+'), ' ')) AS program FROM conversations")
def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n_bytes"), F.size(tokens("[0-9]+")).cast("long").alias("numbers"), F.size(tokens("[A-Za-z]+")).cast("long").alias("names"), F.md5(F.array_join(tokens("[0-9]+|[A-Za-z]+"), " ")).alias("program"))


@query("SELECT user_id, event_id, TRY_CAST(regexp_extract(props, '\"k\": (-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def dictionary_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
