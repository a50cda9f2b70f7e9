"""Queries over colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend
from .catalog import query, table


def _case(cases: dict[str, str], other: str) -> str:
    return "CASE mode " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


def _sql() -> str:
    part = lambda a, b: f"((({a}) * ({b}) + 127) // 255)"
    hard = lambda a, b: f"(CASE WHEN {a} <= 127 THEN {part(f'2 * {a}', b)} ELSE 255 - {part(f'2 * (255 - {a})', f'255 - {b}')} END)"
    each = lambda f: ", ".join(f(c) for c in "rgb")
    luma = lambda p: f"((77 * {p}r + 150 * {p}g + 29 * {p}b + 128) // 256)"
    least, most = (lambda p: f"least({p}r, {p}g, {p}b)"), (lambda p: f"greatest({p}r, {p}g, {p}b)")
    span = lambda p: f"({most(p)} - {least(p)})"
    tint = lambda c, p, q: f"CASE WHEN {span(p)} = 0 THEN 0 ELSE ({p}{c} - {least(p)}) * {span(q)} // {span(p)} END"

    def channel(c: str) -> str:
        s, d = f"s{c}", f"d{c}"
        curve = f"(CASE WHEN {d} <= 63 THEN ((16 * {d} - 3060) * {d} + 260100) * {d} // 65025 ELSE CAST(floor(sqrt({d} * 255)) AS BIGINT) END)"
        soft = f"CASE WHEN {s} <= 127 THEN {d} - {part(part(f'255 - 2 * {s}', d), f'255 - {d}')} ELSE {d} + {part(f'2 * {s} - 255', f'{curve} - {d}')} END"
        return _case({
            "multiply": part(s, d), "screen": f"{s} + {d} - {part(s, d)}", "overlay": hard(d, s), "darken": f"least({s}, {d})", "lighten": f"greatest({s}, {d})",
            "color_dodge": f"CASE WHEN {s} = 255 THEN 255 ELSE least(255, {d} * 255 // (255 - {s})) END", "color_burn": f"CASE WHEN {s} = 0 THEN 0 ELSE 255 - least(255, (255 - {d}) * 255 // {s}) END",
            "hard_light": hard(s, d), "soft_light": soft, "difference": f"abs({s} - {d})", "exclusion": f"{s} + {d} - 2 * {part(s, d)}",
        }, f"least(255, greatest(0, e{c}))")

    shares = {name: f("sa", "da") for name, f in {  # as text: the numbers of the modes that only weigh
        "clear": lambda s, d: ("0", "0"), "source_over": lambda s, d: ("255", f"255 - {s}"), "destination_over": lambda s, d: (f"255 - {d}", "255"), "source_in": lambda s, d: (d, "0"),
        "destination_in": lambda s, d: ("0", s), "source_out": lambda s, d: (f"255 - {d}", "0"), "destination_out": lambda s, d: ("0", f"255 - {s}"), "source_atop": lambda s, d: (d, f"255 - {s}"),
        "destination_atop": lambda s, d: (f"255 - {d}", s), "xor": lambda s, d: (f"255 - {d}", f"255 - {s}"),
    }.items()}
    meets = "mode IN (" + ", ".join(f"'{n}'" for n in (*blend.CHANNELS, *blend.TONES)) + ")"
    whole = lambda s, d, extra: f"CASE WHEN mode = 'plus' THEN least(255, {s} + {d}) WHEN mode = 'modulate' THEN {part(s, d)} WHEN {meets} THEN least(255, least(255, {part(s, 'ws')} + {part(d, 'wd')}) + {extra}) ELSE least(255, {part(s, 'ws')} + {part(d, 'wd')}) END"
    byte = lambda k: f"CAST(('0x' || substr(md5(p_name || p_partkey), {2 * k + 1}, 2))::INT AS BIGINT)"
    names = ", ".join(f"'{n}'" for n in blend.MODES)
    return f"""
    WITH x AS (SELECT p_partkey, [{names}][p_partkey % 29 + 1] AS mode, {', '.join(f'{byte(i)} AS {c}' for i, c in enumerate(('sr', 'sg', 'sb', 'dr', 'dg', 'db')))},
                      CASE WHEN p_partkey % 5 = 0 THEN 255 ELSE {byte(6)} END AS sa, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 1 THEN 255 ELSE {byte(7)} END AS da FROM part),
    t AS (SELECT *, {each(lambda c: _case({'hue': tint(c, 's', 'd'), 'saturation': tint(c, 'd', 's'), 'color': f's{c}'}, f'd{c}') + f' AS b{c}')}, CASE WHEN mode = 'luminosity' THEN {luma('s')} ELSE {luma('d')} END AS goal FROM x),
    u AS (SELECT *, {each(lambda c: f"b{c} + goal - {luma('b')} AS c{c}")} FROM t),
    v AS (SELECT *, {luma('c')} AS l, {least('c')} AS low, {most('c')} AS high FROM u),
    w AS (SELECT *, {each(lambda c: f"CASE WHEN low < 0 THEN l + (c{c} - l) * l // (l - low) ELSE c{c} END AS f{c}")} FROM v),
    y AS (SELECT *, {each(lambda c: f"CASE WHEN high > 255 THEN l + (f{c} - l) * (255 - l) // (high - l) ELSE f{c} END AS e{c}")}, {_case({k: a[0] for k, a in shares.items()}, '255 - da')} AS ws, {_case({k: a[1] for k, a in shares.items()}, '255 - sa')} AS wd FROM w),
    z AS (SELECT *, {each(lambda c: f"{channel(c)} AS m{c}")} FROM y),
    o AS (SELECT *, {each(lambda c: whole(part(f's{c}', 'sa'), part(f'd{c}', 'da'), part(part(f'm{c}', 'sa'), 'da')) + f' AS made_{c}')}, CASE WHEN {meets} THEN least(255, sa + {part('da', '255 - sa')}) ELSE {whole('sa', 'da', '0')} END AS oa FROM z)
    SELECT p_partkey, mode, {each(lambda c: f"CASE WHEN mode = 'source' THEN CASE WHEN sa = 0 THEN 0 ELSE s{c} END WHEN mode = 'destination' THEN CASE WHEN da = 0 THEN 0 ELSE d{c} END WHEN oa = 0 THEN 0 ELSE least(255, (made_{c} * 255 + oa // 2) // oa) END AS {c}")},
           CASE mode WHEN 'source' THEN sa WHEN 'destination' THEN da ELSE oa END AS a FROM o"""


@query(_sql())
def blend_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of 29 modes for each part, on bytes of a digest; alphas of 0 and 255 among them."""
    k = F.col("p_partkey")
    byte = lambda i: F.conv(F.substring(F.md5(F.concat("p_name", k.cast("string"))), 2 * i + 1, 2), 16, 10).cast("long")
    mode = F.element_at(F.array(*(F.lit(n) for n in blend.MODES)), (k % 29 + 1).cast("int"))
    source = F.when(k % 5 == 0, F.lit(255).cast("long")).otherwise(byte(6))
    target = F.when(k % 7 == 0, F.lit(0).cast("long")).when(k % 7 == 1, F.lit(255).cast("long")).otherwise(byte(7))
    colors = [byte(i).alias(c) for i, c in enumerate(("sr", "sg", "sb", "dr", "dg", "db"))]
    rows = table(spark, sf_dir, "part").select("p_partkey", mode.alias("mode"), *colors, source.alias("sa"), target.alias("da"))
    return blend.blended(rows, "mode").select("p_partkey", "mode", *"rgba")
