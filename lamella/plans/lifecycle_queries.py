"""Queries over held ranges, signals, layers and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from ..operators import lifecycles
from .catalog import query, table


@query("""
    WITH q AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber, l_partkey) AS request, l_partkey * 7 % 1050 AS a, l_partkey * 7 % 1050 + l_quantity::BIGINT AS b FROM lineitem WHERE l_linenumber = 1),
         d AS (SELECT DISTINCT l_suppkey, a, b FROM q), u AS (SELECT DISTINCT ps AS l_suppkey, unnest(range(s, e)) AS byte FROM (SELECT l_suppkey AS ps, l_orderkey * 13 % 1000 AS s, l_orderkey * 13 % 1000 + 20 AS e FROM lineitem WHERE l_linenumber = 2)),
         c AS (SELECT d.l_suppkey, a, b, count(byte) AS got FROM d LEFT JOIN u ON u.l_suppkey = d.l_suppkey AND byte >= a AND byte < least(b, 1000) GROUP BY ALL)
    SELECT l_suppkey, a AS start, b AS "end", greatest(least(b, 1000) - a - got, 0) AS missing, CASE WHEN a >= 1000 THEN 'eof' WHEN least(b, 1000) - a - got <= 0 THEN 'ready' ELSE 'pending' END AS status FROM c""")
def range_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct request against what its supplier holds of 1000 bytes."""
    items = table(spark, sf_dir, "lineitem")
    start, s = (F.col("l_partkey") * 7 % 1050).cast("long"), (F.col("l_orderkey") * 13 % 1000).cast("long")
    asked = items.where("l_linenumber = 1").select("l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct().withColumn("request", F.struct("start", "end"))
    held = items.where("l_linenumber = 2").select("l_suppkey", s.alias("s"), (s + 20).alias("e"))
    return lifecycles.poll_ranges(asked, held, "l_suppkey", 1000, 64).drop("request")


@query("""
    WITH t AS (SELECT event_id, user_id * 16 + event_id % 16 AS work, ['start', 'cancel', 'fail', 'complete'][(event_id * 31 // 16 + user_id) % 4 + 1] AS action FROM events),
         b AS (SELECT *, min(event_id) FILTER (action = 'start') OVER (PARTITION BY work) AS begun FROM t), e AS (SELECT *, min(event_id) FILTER (action <> 'start' AND event_id > begun) OVER (PARTITION BY work) AS ended FROM b)
    SELECT event_id, work, action, CASE WHEN action = 'start' THEN CASE WHEN event_id = begun THEN 'started' ELSE 'duplicate' END WHEN begun IS NULL OR event_id < begun THEN 'unknown' WHEN event_id = ended THEN 'accepted' ELSE 'late' END AS decision FROM e""")
def terminal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id").cast("long"), F.col("user_id").cast("long")
    action = F.element_at(F.array(*(F.lit(a) for a in ("start", "cancel", "fail", "complete"))), ((F.floor(k * 31 / 16) + u) % 4 + 1).cast("int"))
    return lifecycles.arbitrate(table(spark, sf_dir, "events").select("event_id", (u * 16 + k % 16).alias("work"), action.alias("action")), "work", "event_id", "action")


_MIX = "CAST(({s} * 65536 + {p} * (65536 - {a}) + 32768) // 65536 AS BIGINT)"
_SOURCE, _SHAPE = "((q.{n} * q.o + 32768) // 65536)", "(CASE WHEN q.k = 1 THEN q.a ELSE (q.a * q.o + 32768) // 65536 END)"


@query(f"""
    WITH l AS (SELECT o_custkey, o_orderkey, CAST(o_orderkey * 37 % 65537 AS BIGINT) AS a, CAST(o_orderkey % 256 AS BIGINT) AS b, CAST(o_orderkey * 101 % 65537 AS BIGINT) AS o, CAST(o_orderkey % 4 = 0 AS BIGINT) AS k FROM orders),
         g AS (SELECT o_custkey, count(*) AS layers, list({{'c': a * b // 255, 'a': a, 'o': o, 'k': k}} ORDER BY o_orderkey) AS stack FROM l GROUP BY 1),
         t AS (SELECT o_custkey, layers, list_reduce(list_prepend({{'c': 0::BIGINT, 'a': 0::BIGINT, 'o': 0::BIGINT, 'k': 0::BIGINT}}, stack), lambda p, q:
                 {{'c': {_MIX.format(s=_SOURCE.format(n='c'), p='p.c', a=_SHAPE)}, 'a': {_MIX.format(s=_SOURCE.format(n='a'), p='p.a', a=_SHAPE)}, 'o': 0::BIGINT, 'k': 0::BIGINT}}) AS r FROM g)
    SELECT o_custkey, layers, r.c AS c, r.a AS a, CASE WHEN r.a > 0 THEN (least(65536, (r.c * 65536 + r.a // 2) // r.a) * 255 + 32768) // 65536 ELSE 0 END AS color_byte, (r.a * 255 + 32768) // 65536 AS alpha_byte FROM t""")
def layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as layers, every fourth a knockout."""
    k = F.col("o_orderkey").cast("long")
    a = k * 37 % 65537
    layers = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(a * (k % 256) / 255).alias("c"), a.alias("a"), (k * 101 % (fx.ONE + 1)).alias("opacity"), (k % 4 == 0).alias("knockout"))
    return lifecycles.composite(layers, "o_custkey", "o_orderkey")


@query("""
    WITH r AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS st, CAST(o_custkey * 13 % 500 AS BIGINT) AS x0, CAST(o_orderkey * 29 % 300 AS BIGINT) AS y0, o_orderkey % 90 AS w, o_custkey % 70 AS h FROM orders),
         g AS (SELECT x AS tx, y AS ty FROM range(8) a(x), range(5) b(y))
    SELECT tx, ty, count(*) FILTER (st) AS state_commands, count(*) FILTER (NOT st) AS visible_commands, min(o_orderkey) AS first_command
    FROM g JOIN r ON st OR (w > 0 AND h > 0 AND x0 < (tx + 1) * 64 AND x0 + w > tx * 64 AND y0 < (ty + 1) * 64 AND y0 + h > ty * 64) GROUP BY tx, ty""")
def tile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    x0, y0 = c * 13 % 500, k * 29 % 300
    commands = table(spark, sf_dir, "orders").select("o_orderkey", (k % 50 == 0).alias("is_state"), x0.alias("x0"), y0.alias("y0"), (x0 + k % 90).alias("x1"), (y0 + c % 70).alias("y1"))
    on = lifecycles.tile_commands(commands, 64, 8, 5)
    return on.groupBy("tx", "ty").agg(F.count_if("is_state").alias("state_commands"), F.count_if(~F.col("is_state")).alias("visible_commands"), F.min("o_orderkey").alias("first_command"))


_ACTIONS = ["allocate", "write", "publish", "transfer", "import", "acquire", "write", "release", "expire", "close", "transfer", "publish"]
_MOVES = "MAP {" + ", ".join(f"'{a}|{b}': '{c}|{d}'" for (a, b), (c, d) in lifecycles.SURFACE.items()) + "}"


@query(f"""
    WITH RECURSIVE t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, {_ACTIONS}[CASE WHEN l_orderkey % 3 = 0 THEN l_partkey % 12 ELSE (l_linenumber - 1) % 12 END + 1] AS action FROM lineitem),
      w AS (SELECT l_orderkey, 0::BIGINT AS n, ''::VARCHAR AS action, 'none' AS state, '' AS outcome FROM (SELECT DISTINCT l_orderkey FROM lineitem)
            UNION ALL SELECT w.l_orderkey, t.n, t.action, split_part(coalesce({_MOVES}[w.state || '|' || t.action], w.state || '|refused'), '|', 1), split_part(coalesce({_MOVES}[w.state || '|' || t.action], w.state || '|refused'), '|', 2) FROM w JOIN t ON t.l_orderkey = w.l_orderkey AND t.n = w.n + 1)
    SELECT * FROM w WHERE n > 0""")
def surface_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as actions on one surface: in two of three orders as they should come, else in any order."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_partkey") % 12).otherwise((F.col("l_linenumber") - 1) % 12) + 1
    action = F.element_at(F.array(*(F.lit(a) for a in _ACTIONS)), k.cast("int"))
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(place).cast("long").alias("n"), action.alias("action"))
    return lifecycles.automaton(events, "l_orderkey", "n", "action", lifecycles.SURFACE, "none", "refused")
