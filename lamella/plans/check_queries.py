"""Validations, lookups, render plans and small arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scheduling
from .catalog import query, table


@query("SELECT p_partkey, (p_size * 36) // gcd(p_size * 36, p_partkey % 90 + 6) AS numerator, (p_partkey % 90 + 6) // gcd(p_size * 36, p_partkey % 90 + 6) AS denominator FROM part")
def zoom_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("p_size") * 36).cast("long"), F.col("p_partkey") % 90 + 6
    # Euclid as a fold: numbers under 2^12 take fewer than 18 steps
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % s["y"]).otherwise(F.lit(0)).alias("y")))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(18)), F.struct(a.alias("x"), b.alias("y")), step)["x"]
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(a / g).alias("numerator"), F.floor(b / g).alias("denominator"))


@query("SELECT l_suppkey, bit_or(CAST(1 AS BIGINT) << CAST(l_partkey % 16 AS INT)) AS coverage_union, bit_and(CAST(65535 AS BIGINT) - (CAST(1 AS BIGINT) << CAST(l_partkey % 16 AS INT))) AS coverage_common, (bit_count(bit_or(CAST(1 AS BIGINT) << CAST(l_partkey % 16 AS INT))) * 255 + 8) // 16 AS alpha FROM lineitem GROUP BY l_suppkey")
def coverage_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = F.expr("shiftleft(1L, cast(l_partkey % 16 as int))")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.bit_or(bit).alias("coverage_union"), F.bit_and(F.lit(65535) - bit).alias("coverage_common"), F.floor((F.bit_count(F.bit_or(bit)) * 255 + 8) / 16).alias("alpha"))


@query("SELECT o_custkey, min(o_orderkey % 500) AS x0, max(o_orderkey % 500) AS x1, min(o_orderkey % 301) AS y0, max(o_orderkey % 301) AS y1, count(*) AS points FROM orders GROUP BY o_custkey")
def path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("o_orderkey") % 500, F.col("o_orderkey") % 301
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("points"))


@query("""
    WITH p AS (SELECT p_partkey, p_size * 20 + 100 AS w, p_partkey % 700 + 90 AS h FROM part), c AS (SELECT *, unnest(range(0, (w + 255) // 256)) AS tx FROM p), t AS (SELECT *, unnest(range(0, (h + 255) // 256)) AS ty FROM c)
    SELECT p_partkey, tx, ty, least(256, w - tx * 256) AS width, least(256, h - ty * 256) AS height, substr(sha256('tile|' || p_partkey || '|' || tx || '|' || ty || '|' || w || 'x' || h), 1, 16) AS identity FROM t""")
def render_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20 + 100).cast("long").alias("w"), (F.col("p_partkey") % 700 + 90).alias("h"))
    cells = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(c) + 255) / 256) - 1))
    t = p.withColumn("tx", cells("w")).withColumn("ty", cells("h"))
    identity = F.sha2(F.concat(F.concat_ws("|", F.lit("tile"), "p_partkey", "tx", "ty", F.concat_ws("x", "w", "h"))), 256)
    return t.select("p_partkey", "tx", "ty", F.least(F.lit(256), F.col("w") - F.col("tx") * 256).alias("width"), F.least(F.lit(256), F.col("h") - F.col("ty") * 256).alias("height"), F.substring(identity, 1, 16).alias("identity"))


@query("""
    SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'absent' WHEN c_nationkey <> o_custkey % 25 THEN 'other-generation' WHEN c_acctbal < 0 THEN 'other-quality' ELSE 'hit' END AS outcome
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0""")
def tile_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    reason = F.when(F.col("c_nationkey").isNull(), "absent").when(F.col("c_nationkey") != F.col("o_custkey") % 25, "other-generation").when(F.col("c_acctbal") < 0, "other-quality").otherwise("hit")
    return table(spark, sf_dir, "orders").join(held, "o_custkey", "left").select("o_orderkey", reason.alias("outcome"))


@query("""
    WITH names AS (SELECT c_nationkey AS scope, c_mktsegment AS name, count(*) AS n, min(c_custkey) AS target FROM customer GROUP BY ALL)
    SELECT s_suppkey, CASE WHEN n IS NULL THEN 'missing' WHEN n > 40 THEN 'ambiguous' ELSE 'ready' END AS outcome, CASE WHEN n <= 40 THEN target END AS target
    FROM supplier LEFT JOIN names ON scope = s_nationkey AND name = CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'NOSUCH' END""")
def resource_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("target"))
    k = F.col("s_suppkey") % 3
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scope"), F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("NOSUCH").alias("name"))
    out = asked.join(names, ["scope", "name"], "left")
    return out.select("s_suppkey", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 40, "ambiguous").otherwise("ready").alias("outcome"), F.when(F.col("n") <= 40, F.col("target")).alias("target"))


@query("SELECT url, url LIKE 'http%' AS is_url, regexp_matches(url, '(^|/)\\.\\.(/|$)|\\\\|^/') AS unsafe, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("url", u.like("http%").alias("is_url"), u.rlike(r"(^|/)\.\.(/|$)|\\|^/").alias("unsafe"), F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"))


@query("""
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 1000 AS number, lag(o_orderkey % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
    SELECT o_custkey, o_orderkey, CASE WHEN number >= 950 THEN 'out-of-bounds' WHEN before IS NOT NULL AND number <= before THEN 'not-increasing' END AS violation FROM r WHERE number >= 950 OR number <= before""")
def row_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey") % 1000
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", number.alias("number"), F.lag(number).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"))
    v = F.when(F.col("number") >= 950, "out-of-bounds").when(F.col("number") <= F.col("before"), "not-increasing")
    return r.select("o_custkey", "o_orderkey", v.alias("violation")).where("violation is not null")


@query("""
    WITH rules(kind, requirement) AS (VALUES ('view', 1), ('view', 4), ('click', 2), ('purchase', 2), ('purchase', 3), ('error', 9))
    SELECT user_id, requirement, count(*) AS uses, min(event_id) AS first_use FROM events JOIN rules ON kind = event_type GROUP BY ALL""")
def derived_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("view", 1), ("view", 4), ("click", 2), ("purchase", 2), ("purchase", 3), ("error", 9)], "event_type string, requirement int")
    return table(spark, sf_dir, "events").join(F.broadcast(rules), "event_type").groupBy("user_id", "requirement").agg(F.count("*").alias("uses"), F.min("event_id").alias("first_use"))


@query("SELECT event_id, user_id, CASE WHEN event_id + CAST(round(value) AS BIGINT) <= 5000 THEN 'expired' ELSE 'live' END AS lifecycle FROM events")
def surface_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    deadline = F.col("event_id") + F.round("value").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(deadline <= 5000, "expired").otherwise("live").alias("lifecycle"))


@query("""
    WITH b AS (SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 2))::INT AS a, ('0x' || substr(md5(p_name), 3, 2))::INT AS b, ('0x' || substr(md5(p_name), 5, 2))::INT AS c FROM part)
    SELECT p_partkey, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END AS paeth,
           sign((a - b) * (c - b) - (c - a) * (b - 7)) AS turn, [17, 34, 51, 68, 85, 102, 119, 136][a % 8 + 1] AS palette FROM b""")
def pixel_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda k: F.conv(F.substring(F.md5("p_name"), k, 2), 16, 10).cast("int")
    p = table(spark, sf_dir, "part").select("p_partkey", byte(1).alias("a"), byte(3).alias("b"), byte(5).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    da, db, dc = F.abs(b - c), F.abs(a - c), F.abs(a + b - 2 * c)
    paeth = F.when((da <= db) & (da <= dc), a).when(db <= dc, b).otherwise(c)
    palette = F.element_at(F.array(*(F.lit(17 * k) for k in range(1, 9))), (a % 8 + 1).cast("int"))
    return p.select("p_partkey", paeth.alias("paeth"), F.signum(((a - b) * (c - b) - (c - a) * (b - 7)).cast("double")).cast("int").alias("turn"), palette.alias("palette"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(19,9)) * 1000000000 AS DECIMAL(38,0)) AS units, o_totalprice <= 9223372036 AS in_range FROM orders")
def decimal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.col("o_totalprice").cast("decimal(19,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", units.cast("decimal(38,0)").alias("units"), (F.col("o_totalprice") <= 9223372036).alias("in_range"))


@query()
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, evictions and peak weight of each user's cache."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 17).alias("k"), (F.col("event_id") * 31 % 17 * 10 + 5).alias("w"))
    log = scheduling.lru(e, "user_id", "event_id", "k", "w", 8, 400)
    return log.groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum("evicted").alias("evictions"), F.max("held").alias("peak"))


@query()
def tile_cache_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache in which tiles outside the current viewport go before those inside."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 31 % 23).alias("k"), F.floor(F.col("event_id") / 2000).alias("viewport"))
    return scheduling.segmented(e, "user_id", "event_id", "k", "viewport", 6)
