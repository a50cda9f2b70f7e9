"""Queries over places of objects, revision chains, fonts' codes, strict numbers and filter plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import characters
from ..functions.codecs import predicted
from ..operators import objects
from .catalog import query, table


@query("""
    WITH e AS (SELECT o_orderkey // 1000 AS doc, o_orderkey AS object, CASE WHEN o_orderkey % 5 = 0 THEN 'free' WHEN o_orderkey % 5 <= 2 THEN 'plain' ELSE 'packed' END AS kind,
                      o_orderkey * 40 AS offset_, o_orderkey - o_orderkey % 5 + 1 + o_orderkey % 7 // 6 * 4 AS container, o_orderkey % 5 - 3 AS idx FROM orders)
    SELECT e.doc, e.object, e.kind, CASE WHEN e.kind = 'packed' THEN h.offset_ ELSE e.offset_ END AS place, CASE WHEN e.kind = 'packed' THEN e.idx END AS index,
           CASE WHEN e.kind = 'packed' AND h.object IS NULL THEN 'container-missing' ELSE 'ready' END AS outcome
    FROM e LEFT JOIN e h ON h.doc = e.doc AND h.object = e.container AND h.kind = 'plain' WHERE e.kind <> 'free'""")
def object_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    kind = F.when(k % 5 == 0, "free").when(k % 5 <= 2, "plain").otherwise("packed")
    container = k - k % 5 + 1 + F.floor(k % 7 / 6) * 4
    return objects.locators(table(spark, sf_dir, "orders").select(F.floor(k / 1000).alias("doc"), k.alias("object"), kind.alias("kind"), (k * 40).alias("offset"), container.alias("container"), (k % 5 - 3).alias("index")))


@query("""
    WITH r AS (SELECT c_nationkey AS doc, c_custkey AS revision, c_custkey * 37 % 500 AS anchor, 100 AS size, c_custkey % 100 + 1 AS root, c_custkey % 3 AS rg FROM customer),
         e AS (SELECT s_nationkey AS doc, s_suppkey AS object, s_suppkey % 3 AS g, s_suppkey % 4 = 0 AS free, s_suppkey * 7 % 120 AS next_free FROM supplier),
         n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc ORDER BY revision DESC) = 1),
         m AS (SELECT n.*, e.g FROM n LEFT JOIN e ON e.doc = n.doc AND e.object = n.root AND NOT e.free)
    SELECT doc, 'anchor-repeats' AS fault, anchor AS at FROM r GROUP BY doc, anchor HAVING count(*) > 1
    UNION ALL SELECT e.doc, 'free-out-of-bounds', e.object FROM e JOIN n ON n.doc = e.doc WHERE e.free AND e.next_free >= n.size
    UNION ALL SELECT doc, 'root-not-live', root FROM m WHERE g IS NULL
    UNION ALL SELECT doc, 'root-generation', root FROM m WHERE g <> rg""")
def chain_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    revisions = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), c.alias("revision"), (c * 37 % 500).alias("anchor"), F.lit(100).alias("size"), (c % 100 + 1).alias("root"), (c % 3).alias("root_generation"))
    kind = F.when(s % 4 == 0, "free").otherwise("plain")
    entries = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc"), s.alias("object"), (s % 3).alias("generation"), kind.alias("kind"), (s * 7 % 120).alias("next_free"))
    return objects.chain_faults(revisions, entries)


_SEGMENTS = "SELECT s_nationkey AS font, CAST(s_suppkey AS BIGINT) AS ordinal, CAST(s_suppkey * 97 % 3000 - s_suppkey % 40 AS BIGINT) AS seg_start, CAST(s_suppkey * 97 % 3000 AS BIGINT) AS seg_end, CAST(s_suppkey % 200 - 100 AS BIGINT) AS delta FROM supplier"


@query(f"""
    WITH s AS ({_SEGMENTS}), c AS (SELECT p_partkey, p_partkey % 25 AS font, CAST(p_partkey * 31 % 3000 AS BIGINT) AS code FROM part),
         h AS (SELECT c.*, s.seg_start, s.delta FROM c LEFT JOIN s ON s.font = c.font AND s.seg_end >= c.code QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY seg_end, ordinal) = 1)
    SELECT font, code, CASE WHEN code >= seg_start THEN ((code + delta) % 65536 + 65536) % 65536 ELSE 0 END AS glyph FROM h""")
def cmap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("s_suppkey").cast("long"), F.col("p_partkey").cast("long")
    segments = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("font"), s.alias("ordinal"), (s * 97 % 3000 - s % 40).alias("seg_start"), (s * 97 % 3000).alias("seg_end"), (s % 200 - 100).alias("delta"))
    return objects.cmap_glyphs(table(spark, sf_dir, "part").select((p % 25).alias("font"), (p * 31 % 3000).alias("code")), segments)


@query("""
    WITH w AS (SELECT c_nationkey AS font, CAST(c_custkey * 17 % 300 AS BIGINT) AS code, max(c_custkey % 900) AS width FROM customer GROUP BY ALL)
    SELECT p_partkey, CASE WHEN n_nationkey % 2 = 0 THEN coalesce(width, 1000 + n_nationkey) ELSE width END AS width
    FROM part JOIN nation ON n_nationkey = p_partkey % 25 LEFT JOIN w ON w.font = n_nationkey AND w.code = p_partkey * 31 % 300""")
def character_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, n = F.col("c_custkey"), F.col("p_partkey"), F.col("n_nationkey").cast("long")
    widths = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("font"), (c * 17 % 300).cast("long").alias("code")).agg(F.max(c % 900).cast("long").alias("width"))
    fonts = table(spark, sf_dir, "nation").select(n.alias("font"), F.when(n % 2 == 0, "identity").otherwise("simple").alias("kind"), (n + 1000).alias("default_width"))
    asked = table(spark, sf_dir, "part").select("p_partkey", (p % 25).cast("long").alias("font"), (p * 31 % 300).cast("long").alias("code"))
    return objects.code_widths(asked, fonts, widths).select("p_partkey", "width")


_TABLE = "[" + ",".join(f"'{characters.WINANSI.get(b, chr(b))}'" if b != 39 else "''''" for b in range(32, 256)) + "]"


@query(f"""
    WITH b AS (SELECT p_partkey, list_transform(range(16), lambda i: ('0x' || substr(translate(md5(p_name), '01', 'ab'), CAST(2 * i + 1 AS BIGINT), 2))::INT) AS b FROM part)
    SELECT p_partkey, array_to_string(list_transform(b, lambda x: {_TABLE}[x - 31]), '') AS text, FALSE AS refused FROM b""")
def single_byte_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bytes from 22 to FF for each part."""
    data = F.unhex(F.translate(F.md5("p_name"), "01", "ab"))
    return table(spark, sf_dir, "part").select("p_partkey", characters.winansi(data).alias("text"), characters.winansi(data).isNull().alias("refused"))


@query("""
    WITH d AS (SELECT p_partkey, p_partkey % 9 AS n, p_partkey % 2 + 1 AS w, md5(p_name) AS m FROM part)
    SELECT p_partkey, CASE WHEN n % w = 0 THEN n // w END AS n_codes, CASE WHEN n % w = 0 AND n > 0 THEN ('0x' || substr(m, CAST(2 * (n - w) + 1 AS BIGINT), CAST(2 * w AS BIGINT)))::INT END AS last_code FROM d""")
def character_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of one byte or of two; bytes that do not come out even have none."""
    k = F.col("p_partkey")
    data = F.substr(F.unhex(F.md5("p_name")), F.lit(1), (k % 9).cast("int"))
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 1, characters.codes(data, 2)).otherwise(characters.codes(data, 1)).alias("c"))
    return d.select("p_partkey", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("n_codes"), F.when(F.size("c") > 0, F.element_at("c", -1)).alias("last_code"))


@query(f"""
    WITH h AS (SELECT p_partkey, list_reduce(list_prepend({characters.BASIS}::HUGEINT, list_transform(range(length(p_brand)), lambda i: ascii(substr(p_brand, CAST(i + 1 AS BIGINT), 1))::HUGEINT)),
                 lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * {characters.PRIME}::HUGEINT) % 18446744073709551616::HUGEINT) AS hash FROM part)
    SELECT p_partkey, CAST(hash AS DECIMAL(38,0)) AS hash, CAST(hash % 64 AS BIGINT) AS slot FROM h""")
def name_hash_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select("p_partkey", characters.name_hash(F.encode("p_brand", "UTF-8")).cast("decimal(38,0)").alias("hash"))
    return h.withColumn("slot", F.pmod("hash", F.lit(64).cast("decimal(38,0)")).cast("long"))


@query("""
    WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderkey % 1000 AS n FROM orders)
    SELECT o_orderkey, CAST(CASE kind WHEN 0 THEN n * 1000000000 WHEN 1 THEN -n * 1000000000 - 500000000 WHEN 2 THEN n * 1000000 WHEN 3 THEN n * 1000000000 END AS DECIMAL(38,0)) AS units FROM t""")
def strict_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs, missing whole parts and fractions; exponents and a tenth digit are refused."""
    k, n = F.col("o_orderkey"), (F.col("o_orderkey") % 1000).cast("string")
    texts = [F.concat(F.lit("+"), n), F.concat(F.lit("-"), n, F.lit(".5")), F.concat(F.lit("."), F.lpad(n, 3, "0")), F.concat(n, F.lit(".")), F.concat(n, F.lit("e1")), F.concat(n, F.lit(".0123456789"))]
    text = F.coalesce(*(F.when(k % 6 == i, t) for i, t in enumerate(texts)))
    return table(spark, sf_dir, "orders").select("o_orderkey", characters.scene_scalar(text).alias("units"))


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 3) THEN p_size + 400 ELSE p_partkey % 700 + 90 END AS w, CASE WHEN p_partkey % 4 IN (1, 3) THEN p_partkey % 700 + 90 ELSE p_size + 400 END AS h FROM part)
    SELECT p_partkey, CASE WHEN (640 * h + w // 2) // w BETWEEN 1 AND 2000 THEN (640 * h + w // 2) // w END AS height FROM p""")
def output_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", characters.output_height(k % 700 + 90, F.col("p_size") + 400, k % 4 * 90, F.lit(640), 2000).alias("height"))


@query("""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'parameter-count' ELSE 'ready' END AS outcome, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS n_filters,
           CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 12 END AS last_predictor FROM part""")
def filter_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No filter, two without parameters, two of which one has some, and a count that does not fit."""
    kind = F.col("p_partkey") % 4
    two, none = F.array(F.lit("ASCIIHexDecode"), F.lit("FlateDecode")), F.lit(None).cast("int")
    filters = F.when(kind == 0, F.array().cast("array<string>")).otherwise(two)
    parms = F.when(kind == 2, F.array(none, F.lit(12))).when(kind == 3, F.array(F.lit(12)))
    plan = table(spark, sf_dir, "part").select("p_partkey", characters.filter_plan(filters, parms).alias("plan"))
    last = F.when(F.size("plan") > 0, F.element_at("plan", -1)["predictor"])
    return plan.select("p_partkey", F.when(F.col("plan").isNull(), "parameter-count").otherwise("ready").alias("outcome"), F.when(F.col("plan").isNotNull(), F.size("plan")).cast("long").alias("n_filters"), last.alias("last_predictor"))


@query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN 'unsupported' WHEN 4 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN c_custkey % 5 < 3 THEN md5(c_name) END AS md5,
           CASE c_custkey % 5 WHEN 3 THEN 'predictor-unsupported' WHEN 4 THEN 'png-rows' END AS code FROM customer""")
def predictor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No predictor, differences of one sample a row, rows without difference, an unknown predictor, and a row too short."""
    kind, name = F.col("c_custkey") % 5, F.encode("c_name", "UTF-8")
    row = F.concat(F.unhex(F.lit("00")), name)
    data = F.when(kind == 2, row).when(kind == 4, F.concat(row, F.unhex(F.lit("00")))).otherwise(name)
    predictor = F.element_at(F.array(*(F.lit(v) for v in (1, 2, 15, 7, 12))), (kind + 1).cast("int"))
    columns = F.when(kind == 2, F.octet_length("c_name")).when(kind == 4, F.octet_length("c_name") + 5).otherwise(F.lit(1))
    d = table(spark, sf_dir, "customer").select("c_custkey", predicted(data, predictor, columns).alias("d"))
    return d.select("c_custkey", "d.status", F.md5("d.data").alias("md5"), "d.code")


@query("""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['fill','clip','stroke','color','alpha','blend','image','glyph','mask'][l_linenumber % 9 + 1] AS cap, l_partkey % 8 + 2048 * (l_suppkey % 2) AS v FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (CASE cap WHEN 'fill' THEN v <= 1 WHEN 'clip' THEN v <= 1 WHEN 'stroke' THEN v = 0 WHEN 'color' THEN v IN (1, 3, 4) WHEN 'alpha' THEN v <= 65535 WHEN 'blend' THEN v BETWEEN 0 AND 2
             WHEN 'image' THEN v % 256 IN (1, 3, 4) AND v // 256 % 256 = 8 AND v < 65536 WHEN 'glyph' THEN v <> 0 ELSE FALSE END) AS supported, count(*) AS requirements FROM t GROUP BY l_orderkey""")
def capability_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("fill", "clip", "stroke", "color", "alpha", "blend", "image", "glyph", "mask")))
    cap = F.element_at(names, (F.col("l_linenumber") % 9 + 1).cast("int"))
    value = (F.col("l_partkey") % 8 + F.col("l_suppkey") % 2 * 2048).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(objects.supports(cap, value)).alias("supported"), F.count("*").alias("requirements"))


@query("""
    WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0),
         m AS (SELECT coalesce(e.o_custkey, a.o_custkey) AS o_custkey, e.o_orderkey AS ek, a.o_orderkey AS ak, e.v AS ev, a.v AS av FROM e FULL JOIN a ON a.o_custkey = e.o_custkey AND a.o_orderkey = e.o_orderkey),
         c AS (SELECT o_custkey, count(*) FILTER (ak IS NULL) AS removed, count(*) FILTER (ek IS NULL) AS added, count(*) FILTER (ak IS NOT NULL AND ek IS NOT NULL AND ev IS DISTINCT FROM av) AS changed FROM m GROUP BY 1)
    SELECT *, CASE WHEN removed + added + changed > 6 THEN 'difference-limit' ELSE 'ready' END AS outcome FROM c""")
def scene_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    left = o.where(k % 7 != 0).select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("v"))
    right = o.where(k % 11 != 0).select("o_custkey", "o_orderkey", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return objects.scene_totals(left, right, ["o_custkey", "o_orderkey"], "v", 6)
