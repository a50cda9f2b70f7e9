"""Statistics, corpora, revisions, trees, diffs and spatial queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_point as fx
from ..operators import diffs, revisions, spatial, statistics, trees
from ..session import dealt
from .catalog import query, table

_CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(f"""
    WITH r AS (SELECT event_type, {_CENTS} AS v, row_number() OVER (PARTITION BY event_type ORDER BY {_CENTS}) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n, min(v) AS min_v, min(v) FILTER (k >= (n // 100) * 50 + ((n % 100) * 50 + 99) // 100) AS p50,
           min(v) FILTER (k >= (n // 100) * 95 + ((n % 100) * 95 + 99) // 100) AS p95, min(v) FILTER (k >= (n // 100) * 99 + ((n % 100) * 99 + 99) // 100) AS p99,
           max(v) AS max_v, CASE WHEN n < 21 THEN 'insufficient' ELSE 'meets-configured-minimum' END AS adequacy FROM r GROUP BY event_type, n""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return statistics.sample_summary(samples, ["event_type"], "v", 21)


@query(f"""
    WITH s AS (SELECT user_id, coalesce(sum({_CENTS}) FILTER (event_type = 'view'), 0) AS native, coalesce(sum({_CENTS}) FILTER (event_type = 'click'), 0) AS baseline FROM events GROUP BY user_id)
    SELECT user_id, CAST(native AS BIGINT) AS native, CAST(baseline AS BIGINT) AS baseline, CASE WHEN baseline <> 0 THEN CAST(native * 10000 // baseline AS BIGINT) END AS ratio, CASE WHEN baseline = 0 THEN 'zero-baseline' ELSE 'ready' END AS outcome FROM s""")
def native_baseline_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, cents)), F.lit(0))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(side("view").alias("native"), side("click").alias("baseline"))
    return s.withColumn("ratio", statistics.ratio(F.col("native"), F.col("baseline"))).withColumn("outcome", F.when(F.col("baseline") == 0, "zero-baseline").otherwise("ready"))


@query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS pages, count(DISTINCT source) AS sources, max(n_chars) AS largest FROM documents GROUP BY lang")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("pages"), F.countDistinct("source").alias("sources"), F.max("n_chars").alias("largest"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'de') AND regexp_full_match(source, '[a-z0-9._/@-]+')")
def tier_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & F.col("source").rlike(r"^[a-z0-9._/@-]+$")).select("doc_id", "source", "lang")


_BUCKET = "CAST(CAST(('0x' || substr(sha256(text), 1, 16)) AS UBIGINT) AS HUGEINT) * 10000 // 18446744073709551616"



@query(f"SELECT doc_id, CAST({_BUCKET} AS BIGINT) AS bucket, CASE WHEN {_BUCKET} < 2000 THEN 'holdout' ELSE 'tuning' END AS part FROM documents")
def holdout_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.expr("cast(cast(conv(substring(sha2(text, 256), 1, 16), 16, 10) as decimal(20,0)) * 10000 div 18446744073709551616 as bigint)")
    return table(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket")).withColumn("part", F.when(F.col("bucket") < 2000, "holdout").otherwise("tuning"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
    SELECT o_custkey, o_orderkey, o_orderpriority FROM r WHERE k = 1 AND o_orderstatus <> 'F'""")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.latest_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT sha256(text) AS content, count(*) AS n_rows, count(DISTINCT source) AS n_contents FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def conflicting_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.conflicting_identity(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), "source"), "content", "source")


_REFS = "SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN (p_partkey * 37 + p_size) % (SELECT count(*) * 11 // 10 FROM part) + 1 END AS next FROM part"


@query(f"""
    WITH RECURSIVE refs AS ({_REFS}), walk(id, hops, last, next, path) AS (
        SELECT id, 0, id, next, [id] FROM refs
        UNION ALL SELECT w.id, w.hops + 1, r.id, r.next, list_append(w.path, r.id) FROM walk w JOIN refs r ON r.id = w.next WHERE w.hops < 16 AND NOT list_contains(w.path, w.next)),
    ends AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops DESC) AS k FROM walk)
    SELECT e.id, e.hops, e.last, CASE WHEN e.next IS NULL THEN 'resolved' WHEN list_contains(e.path, e.next) THEN 'cycle' WHEN t.id IS NULL THEN 'missing' ELSE 'depth' END AS outcome
    FROM ends e LEFT JOIN refs t ON t.id = e.next WHERE k = 1""")
def reference_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.agg(F.floor(F.count("*") * 11 / 10).alias("m"))
    refs = part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, (F.col("p_partkey") * 37 + F.col("p_size")) % F.col("m") + 1).alias("next"))
    return revisions.follow_references(refs, 16)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and their customers as one tree."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("is_leaf"), F.lit(None).cast("double").alias("balance"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.lit(False), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("double")))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.lit(True), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return r.union(n).union(c)


_TREE = """tree AS (
    SELECT 'r' || r_regionkey AS id, NULL AS parent, false AS is_leaf, NULL::DOUBLE AS balance FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, false, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::DOUBLE END FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, true, CASE WHEN c_acctbal >= 0 THEN c_acctbal END FROM customer)"""
_UP = "up(id, ancestor, distance, next) AS (SELECT id, id, 0, parent FROM tree UNION ALL SELECT u.id, n.id, u.distance + 1, n.parent FROM up u JOIN tree n ON n.id = u.next)"


@query(f"""
    WITH RECURSIVE {_TREE}, {_UP}, declared AS (SELECT 'n' || c_nationkey AS id, count(*) AS declared FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
    SELECT n.id, count(l.id) AS leaves, coalesce(any_value(d.declared), 0) AS declared, count(l.id) = coalesce(any_value(d.declared), 0) AS ok
    FROM tree n LEFT JOIN (SELECT u.ancestor, u.id FROM up u JOIN tree l ON l.id = u.id AND l.is_leaf) l ON l.ancestor = n.id LEFT JOIN declared d ON d.id = n.id WHERE NOT n.is_leaf GROUP BY n.id""")
def tree_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "customer").where("c_acctbal >= 0").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("id")).agg(F.count("*").alias("declared"))
    nodes = _tree(spark, sf_dir).join(declared, "id", "left").withColumn("declared", F.coalesce("declared", F.lit(0)))
    return trees.subtree_counts(nodes)


@query(f"WITH RECURSIVE {_TREE}, {_UP} SELECT u.id, arg_min(v.balance, u.distance) FILTER (v.balance IS NOT NULL) AS balance, min(u.distance) FILTER (v.balance IS NOT NULL) AS distance FROM up u JOIN tree v ON v.id = u.ancestor GROUP BY u.id")
def inherit_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.inherited(_tree(spark, sf_dir), "balance")


@query(f"""
    WITH RECURSIVE refs AS ({_REFS}), walk(id, depth, next, path) AS (
        SELECT id, 0, next, [id] FROM refs
        UNION ALL SELECT w.id, w.depth + 1, r.next, list_append(w.path, r.id) FROM walk w JOIN refs r ON r.id = w.next WHERE NOT list_contains(w.path, w.next)),
    ends AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS k FROM walk)
    SELECT id, CASE WHEN next IS NULL THEN 'root' WHEN list_contains(path, next) THEN 'cycle' ELSE 'missing' END AS outcome,
           CASE WHEN next IS NULL OR NOT list_contains(path, next) THEN depth END AS depth
    FROM ends WHERE k = 1""")
def tree_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ways up of all nodes end, without a bound on their length."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.floor(F.count("*") * 11 / 10).alias("m"))
    parent = F.when(F.col("p_size") > 5, (F.col("p_partkey") * 37 + F.col("p_size")) % F.col("m") + 1)
    return trees.outcomes(part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("id"), parent.alias("parent")))


_OUTLINE = "outline AS (SELECT event_id AS id, CASE WHEN event_id > 0 THEN event_id // 6 END AS parent, event_type <> 'error' AS open FROM events)"


@query(f"""
    WITH RECURSIVE {_OUTLINE}, up(id, ancestor, next, shown) AS (
        SELECT id, id, parent, true FROM outline UNION ALL SELECT u.id, n.id, n.parent, n.open FROM up u JOIN outline n ON n.id = u.next WHERE u.shown)
    SELECT o.id, coalesce(k.n, 0) AS visible FROM outline o LEFT JOIN (SELECT ancestor AS id, count(*) AS n FROM up WHERE ancestor <> id GROUP BY 1) k ON k.id = o.id""")
def outline_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 6)).alias("parent"), (F.col("event_type") != "error").alias("open"))
    return trees.visible_descendants(nodes)


_DEPS = "dep AS (SELECT p_partkey AS id, p_partkey // 2 AS on_id FROM part WHERE p_partkey >= 4 UNION ALL SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey >= 14)"


@query(f"""
    WITH RECURSIVE {_DEPS}, need(id, on_id) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT n.id, d.on_id FROM need n JOIN dep d ON d.id = n.on_id)
    SELECT n.id, bool_and(p_size > 3) AS supported, count(*) FILTER (p_size <= 3) AS n_missing, min(p_partkey) FILTER (p_size <= 3) AS first_missing FROM need n JOIN part ON p_partkey = n.on_id GROUP BY n.id""")
def capability_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    on = lambda d: part.where(F.col("p_partkey") >= 2 * d).select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / d).alias("on"))
    return trees.dependency_closure(part.select(F.col("p_partkey").alias("id"), (F.col("p_size") > 3).alias("direct")), on(2).union(on(7)))


_RECT = "CAST(l_partkey * 13 % 1000 AS BIGINT) AS x0, CAST(l_suppkey * 29 % 700 AS BIGINT) AS y0, CAST(l_partkey * 13 % 1000 + l_quantity AS BIGINT) AS x1, CAST(l_suppkey * 29 % 700 + l_linenumber * 9 AS BIGINT) AS y1"


@query(f"""
    WITH r AS (SELECT l_orderkey, {_RECT} FROM lineitem), c AS (SELECT *, unnest(range(x0 // 64, (x1 - 1) // 64 + 1)) AS tx FROM r WHERE x1 > x0 AND y1 > y0), t AS (SELECT *, unnest(range(y0 // 64, (y1 - 1) // 64 + 1)) AS ty FROM c)
    SELECT tx, ty, count(*) AS n, min(l_orderkey) AS first_command, max(l_orderkey) AS last_command FROM t GROUP BY tx, ty""")
def tile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", *_RECT.split(", "))
    return spatial.tiles(rects, 64).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_command"), F.max("l_orderkey").alias("last_command"))


@query("""
    WITH a AS (SELECT s_suppkey AS a, s_suppkey * 97 % 2000 AS x0, s_suppkey * 61 % 2000 AS y0, s_suppkey * 97 % 2000 + 150 AS x1, s_suppkey * 61 % 2000 + 90 AS y1 FROM supplier),
         b AS (SELECT p_partkey AS b, p_partkey * 31 % 2000 AS x0, p_partkey * 17 % 2000 AS y0, p_partkey * 31 % 2000 + p_size AS x1, p_partkey * 17 % 2000 + p_size AS y1 FROM part)
    SELECT a.a, count(*) AS n, min(b.b) AS first_b, max(b.b) AS last_b FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY a.a""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    a = table(spark, sf_dir, "supplier").select(k.alias("a"), (k * 97 % 2000).alias("x0"), (k * 61 % 2000).alias("y0"), (k * 97 % 2000 + 150).alias("x1"), (k * 61 % 2000 + 90).alias("y1"))
    p, s = F.col("p_partkey"), F.col("p_size")
    b = table(spark, sf_dir, "part").select(p.alias("b"), (p * 31 % 2000).alias("x0"), (p * 17 % 2000).alias("y0"), (p * 31 % 2000 + s).alias("x1"), (p * 17 % 2000 + s).alias("y1"))
    return spatial.overlap_counts(a, b, "a", "b", 128)


_D = ", ".join(f"abs(('0x' || substr(sha256(c_name), {2 * k + 1}, 2))::INT - ('0x' || substr(sha256(c_mktsegment), {2 * k + 1}, 2))::INT)" for k in range(32))


@query(f"""
    WITH d AS (SELECT c_custkey, [{_D}] AS d FROM customer)
    SELECT c_custkey, CAST(len(list_filter(range(0, 8), lambda p: list_max(d[p * 4 + 1 : p * 4 + 4]) > 0)) AS BIGINT) AS pixels, CAST(len(list_filter(d, lambda x: x > 0)) AS BIGINT) AS channels,
           {", ".join(f"CAST(list_max([d[p * 4 + {k + 1}] for p in range(0, 8)]) AS BIGINT) AS max_{n}" for k, n in enumerate("rgba"))}, CAST(list_sum(d) AS BIGINT) AS total FROM d""")
def pixel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffers = table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.sha2("c_name", 256)).alias("native"), F.unhex(F.sha2("c_mktsegment", 256)).alias("baseline"))
    return diffs.pixel_diff(buffers, "c_custkey", "native", "baseline")


_PLACED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) - 1"


@query(f"""
    WITH e AS (SELECT l_orderkey, {_PLACED} AS i, l_returnflag AS v FROM lineitem), a AS (SELECT l_orderkey, {_PLACED} AS i, l_linestatus AS v FROM lineitem WHERE l_linenumber <> 3)
    SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, count(e.v) AS n_expected, count(a.v) AS n_actual, count(*) FILTER (e.v <> a.v) AS changed, count(*) FILTER (a.v IS NULL) AS missing, count(*) FILTER (e.v IS NULL) AS unexpected,
           min(coalesce(e.i, a.i)) FILTER (e.v IS DISTINCT FROM a.v) AS first_difference
    FROM e FULL JOIN a ON a.l_orderkey = e.l_orderkey AND a.i = e.i GROUP BY 1""")
def section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    placed = lambda d, v: dealt(d, items, "l_orderkey").select("l_orderkey", F.expr(_PLACED).cast("long").alias("i"), F.col(v).alias("v"))
    return diffs.section_diff(placed(items, "l_returnflag"), placed(items.where("l_linenumber <> 3"), "l_linestatus"), ["l_orderkey"], "i", "v")


@query("""SELECT c_nationkey AS nationkey, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT c_nationkey, -1 AS d FROM customer UNION ALL SELECT s_nationkey, 1 FROM supplier) GROUP BY 1 HAVING sum(d) <> 0""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.multiset_diff(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


_X, _Y = "CAST(round(o_totalprice * 100) AS BIGINT) * 10000000", "CAST(o_orderkey AS BIGINT) * 1234567"
_HALF = "CAST(sign({n}) AS HUGEINT) * ((abs({n}) * 2 + 1000000000) // 2000000000)"


@query(f"""
    WITH p AS (SELECT o_orderkey, CAST({_X} AS HUGEINT) AS x, CAST({_Y} AS HUGEINT) AS y FROM orders), q AS (SELECT *, x * 866025404 + y * -500000000 AS n, x * 500000000 + y * 866025404 AS k FROM p)
    SELECT o_orderkey, CAST({_HALF.format(n='n')} + 1500000000 AS DECIMAL(38,0)) AS x2, CAST({_HALF.format(n='k')} - 2500000000 AS DECIMAL(38,0)) AS y2 FROM q""")
def fixed_point_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"cast({_X} as decimal(19,0)) as x", f"cast({_Y} as decimal(19,0)) as y")
    x, y = F.col("x"), F.col("y")
    return p.select("o_orderkey", fx.affine(x, y, 866025404, -500000000, 1500000000).cast("decimal(38,0)").alias("x2"), fx.affine(x, y, 500000000, 866025404, -2500000000).cast("decimal(38,0)").alias("y2"))


@query("""
    WITH b AS (SELECT p_partkey, (('0x' || substr(md5(p_name), 1, 2))::BIGINT * 65536 + 127) // 255 AS s, (('0x' || substr(md5(p_name), 3, 2))::BIGINT * 65536 + 127) // 255 AS d, (('0x' || substr(md5(p_name), 5, 2))::BIGINT * 65536 + 127) // 255 AS a FROM part)
    SELECT p_partkey, (s * d + 32768) // 65536 AS multiply, s + d - (s * d + 32768) // 65536 AS screen, s + (d * (65536 - a) + 32768) // 65536 AS normal FROM b""")
def q16_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = lambda k: fx.q16(F.conv(F.substring(F.md5("p_name"), k, 2), 16, 10).cast("long"))
    b = table(spark, sf_dir, "part").select("p_partkey", byte(1).alias("s"), byte(3).alias("d"), byte(5).alias("a"))
    s, d = F.col("s"), F.col("d")
    return b.select("p_partkey", fx.multiply(s, d).alias("multiply"), fx.screen(s, d).alias("screen"), fx.normal_over(s, d, F.col("a")).alias("normal"))


@query("SELECT p_partkey, CASE WHEN (p_size * 45 - 900) % 90 = 0 THEN ((p_size * 45 - 900) % 360 + 360) % 360 END AS rotation, p_partkey % 50 < p_size AS valid_box FROM part")
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fx.rotation(F.col("p_size") * 45 - 900).alias("rotation"), (F.col("p_partkey") % 50 < F.col("p_size")).alias("valid_box"))


@query("""
    WITH e(k, ax, ay, bx, b_y) AS (VALUES (0, 0, 0, 40, 10), (1, 40, 10, 30, 45), (2, 30, 45, 5, 30), (3, 5, 30, 45, 25), (4, 45, 25, 0, 0)), p AS (SELECT p_partkey, p_partkey * 7 % 50 AS x, p_partkey * 11 % 50 AS y FROM part),
    hit AS (SELECT p_partkey, CASE WHEN ay <= y AND b_y > y AND (bx - ax) * (y - ay) - (x - ax) * (b_y - ay) < 0 THEN 1 WHEN ay > y AND b_y <= y AND (bx - ax) * (y - ay) - (x - ax) * (b_y - ay) > 0 THEN -1 ELSE 0 END AS w FROM p, e)
    SELECT p_partkey, CAST(sum(w) AS BIGINT) AS winding, sum(w) <> 0 AS nonzero, sum(abs(w)) % 2 = 1 AS even_odd FROM hit GROUP BY p_partkey""")
def path_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [(0, 0, 40, 10), (40, 10, 30, 45), (30, 45, 5, 30), (5, 30, 45, 25), (45, 25, 0, 0)]
    x, y = F.col("p_partkey") * 7 % 50, F.col("p_partkey") * 11 % 50
    # a path has few edges: they are an array of the row, not rows to join
    signs = []
    for ax, ay, bx, by in edges:
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        signs.append(F.when((F.lit(ay) <= y) & (F.lit(by) > y) & (side < 0), 1).when((F.lit(ay) > y) & (F.lit(by) <= y) & (side > 0), -1).otherwise(0))
    w = sum(signs[1:], signs[0])
    crossed = sum((F.abs(s) for s in signs[1:]), F.abs(signs[0]))
    return table(spark, sf_dir, "part").select("p_partkey", w.cast("long").alias("winding"), (w != 0).alias("nonzero"), (crossed % 2 == 1).alias("even_odd"))


@query("SELECT doc_id, sha256(text) AS digest, sha256('lamella/v1|' || length(lang) || ':' || lang || '|' || length(source) || ':' || source) AS identity_digest, octet_length(encode(text)) AS n_bytes FROM documents")
def content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.concat(F.lit("lamella/v1|"), field("lang"), F.lit("|"), field("source")), 256).alias("identity_digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, md5(text) AS md5, lower(substr(hex(text), 1, 16)) AS head, octet_length(encode(text)) AS n_bytes FROM documents")
def hex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.unhex(F.hex(F.encode("text", "UTF-8")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("md5"), F.lower(F.substring(F.hex(back), 1, 16)).alias("head"), F.octet_length(back).cast("long").alias("n_bytes"))
