"""Queries over decoders and page programs."""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decoded
from ..operators.content import page_commands, page_states
from .catalog import query, spread, table


@query("SELECT conv_id, turn, 'ready' AS status, md5(text) AS md5, NULL::VARCHAR AS code FROM conversations")
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex of hex of each text through two decoders."""
    once = F.concat(F.hex(F.encode("text", "UTF-8")), F.lit(">"))
    twice = F.encode(F.concat(F.hex(F.encode(once, "UTF-8")), F.lit("\n>")), "UTF-8")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", decoded(twice, F.array(F.lit("ASCIIHexDecode"), F.lit("ASCIIHexDecode"))).alias("d"))
    return d.select("conv_id", "turn", "d.status", F.md5("d.data").alias("md5"), "d.code")


#: A text that the cases below hold under the two filters whose encoders SQL lacks.
_TEXT = b"stored under a filter, twice stored under a filter"


@query(f"""
    SELECT c_custkey, c_custkey % 10 AS kind, CASE WHEN c_custkey % 10 IN (1, 3, 5, 7, 9) THEN 'failed' ELSE 'ready' END AS status,
           CASE c_custkey % 10 WHEN 0 THEN md5(c_name) WHEN 2 THEN md5(c_name) WHEN 4 THEN md5(repeat('A', 5) || c_name)
             WHEN 6 THEN md5('{_TEXT.decode()}') WHEN 8 THEN md5('{_TEXT.decode()}') END AS md5,
           CASE WHEN c_custkey % 10 = 5 THEN 'rl-no-end' WHEN c_custkey % 2 = 1 THEN 'trailing-data' END AS code
    FROM customer""")
def filter_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filter on data that ends as it should, and on data that does not: bytes after the end, or no end."""
    name, kind = F.encode("c_name", "UTF-8"), F.col("c_custkey") % 10
    raw = lambda x: F.unhex(F.lit(x.hex()))
    digits = F.hex(name)
    literal = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("c_name") - 1), 2, "0")), name)
    flat, a85 = zlib.compress(_TEXT), base64.a85encode(_TEXT) + b"~>"
    cases = [
        ("ASCIIHexDecode", F.encode(F.concat(digits, F.lit("> \n")), "UTF-8")), ("ASCIIHexDecode", F.encode(F.concat(digits, F.lit(">41")), "UTF-8")),
        ("RunLengthDecode", F.concat(literal, raw(b"\x80"))), ("RunLengthDecode", F.concat(literal, raw(b"\x80\x00"))),
        ("RunLengthDecode", F.concat(raw(b"\xfcA"), literal, raw(b"\x80"))), ("RunLengthDecode", literal),
        ("FlateDecode", raw(flat)), ("FlateDecode", raw(flat + b"x")), ("ASCII85Decode", raw(a85 + b"\n")), ("ASCII85Decode", raw(a85 + b"!")),
    ]
    data, which = (F.coalesce(*(F.when(kind == k, c if pick else F.array(F.lit(f))) for k, (f, c) in enumerate(cases))) for pick in (True, False))
    d = table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), decoded(data, which).alias("d"))
    return d.select("c_custkey", "kind", "d.status", F.md5("d.data").alias("md5"), "d.code")


@query("""
    SELECT o_orderkey AS page, unnest([0, 3, 4]) AS ordinal, unnest(['save', 'paint', 'restore']) AS kind, unnest([0, 1, 0]) AS fill,
           CAST(unnest([NULL, (o_orderkey % 97) * 1000000000 + 2500000000, NULL]) AS DECIMAL(38,0)) AS x0, CAST(unnest([NULL, (o_orderkey % 97) * 1000000000 + 2500000000 + 2 * (o_orderkey % 13) * 1000000000, NULL]) AS DECIMAL(38,0)) AS x1, 'ready' AS outcome FROM orders WHERE o_orderkey % 11 <> 0
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, 'unclosed' FROM orders WHERE o_orderkey % 11 = 0""")
def content_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One program a page, every eleventh without its last operator."""
    k = F.col("o_orderkey")
    text = F.format_string("q 2 0 0 2 %d 0 cm 1.25 0 %d 7 re f %s", k % 97, k % 13, F.when(k % 11 == 0, "").otherwise("Q"))
    pages = spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("page"), F.encode(text, "UTF-8").alias("content"))
    out = page_commands(pages)
    return out.select("page", "ordinal", "kind", "fill", "x0", "x1", "outcome")


@query("""
    SELECT o_orderkey AS page, unnest([19, 22, 28]) AS ordinal, unnest(['paint', 'paint', 'glyphs']) AS kind, unnest(['DeviceRGB', 'DeviceGray', 'DeviceCMYK']) AS fill_space, unnest([250000000, 0, 1000000000]) AS fill_last,
           unnest(['DeviceCMYK', 'DeviceGray', 'DeviceGray']) AS stroke_space, unnest([(o_orderkey % 9) * 1000000000 + 500000000, 1000000000, 1000000000]) AS line_width, unnest([1, 0, 0]) AS line_cap, unnest([2, 0, 0]) AS line_join,
           unnest([4000000000, 10000000000, 10000000000]) AS miter_limit, unnest([2, 0, 0]) AS dashes, unnest(['F1', NULL, 'F2']) AS font, unnest([12500000000, 0, -8000000000]) AS font_size, unnest([500000000, 0, 2000000000]) AS char_spacing,
           unnest([0, 0, 1000000000]) AS word_spacing, unnest([(o_orderkey % 50 + 50) * 10000000, 1000000000, 1000000000]) AS scaling, unnest([3, 0, 0]) AS render_mode, unnest([-2000000000, 0, 0]) AS rise, unnest(['G0', NULL, NULL]) AS external, 'ready' AS outcome
    FROM orders WHERE o_orderkey % 7 > 2
    UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE o_orderkey % 7 WHEN 0 THEN 'graphics-parameter' WHEN 1 THEN 'operand-kind' ELSE 'color-components' END FROM orders WHERE o_orderkey % 7 <= 2""")
def content_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, colour and text state under save and restore; three of seven pages end in an operator that has to be refused."""
    k = F.col("o_orderkey")
    wrong = F.when(k % 7 == 0, "-1 w").when(k % 7 == 1, "(a) w").when(k % 7 == 2, "/DeviceRGB cs 1 sc").otherwise("")
    text = F.format_string(
        "q %d.5 w 1 J 2 j 4 M [3 1.5] 1 d 0.1 0.2 0.25 rg /DeviceCMYK CS 0 0 0 2 SCN /F1 12.5 Tf .5 Tc 0 Tw %d Tz 3 Tr -2 Ts /G0 gs /Perceptual ri 9 TL 0 0 5 5 re B "
        "Q 1 1 3 3 re f /DeviceCMYK cs BT /F2 -8 Tf 3 4 Td 0 0 Td 1 2 (x y) \" ET ",
        k % 9, k % 50 + 50,
    )
    out = page_states(spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("page"), F.encode(F.concat(text, wrong), "UTF-8").alias("content")))
    plain = ["stroke_space", "line_width", "line_cap", "line_join", "miter_limit", "font", "font_size", "char_spacing", "word_spacing", "scaling", "render_mode", "rise", "external", "outcome"]
    return out.select("page", "ordinal", "kind", "fill_space", F.element_at("fill_color", -1).alias("fill_last"), F.size("dash").alias("dashes"), *plain)
