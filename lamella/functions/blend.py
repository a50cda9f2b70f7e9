"""Composition of straight 8-bit colours by name of the mode, in whole numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = "rgb"
#: Shares of source and destination, by their alphas, in the modes that only weigh the two.
SHARES: dict[str, Callable] = {
    "clear": lambda s, d: (0, 0),
    "source_over": lambda s, d: (255, 255 - s),
    "destination_over": lambda s, d: (255 - d, 255),
    "source_in": lambda s, d: (d, 0),
    "destination_in": lambda s, d: (0, s),
    "source_out": lambda s, d: (255 - d, 0),
    "destination_out": lambda s, d: (0, 255 - s),
    "source_atop": lambda s, d: (d, 255 - s),
    "destination_atop": lambda s, d: (255 - d, s),
    "xor": lambda s, d: (255 - d, 255 - s),
}
TONES = ("hue", "saturation", "color", "luminosity")


def _div(a: Column, b: Column | int) -> Column:
    """The whole quotient towards zero; null by zero."""
    return F.call_function("div", a, F.nullif(F.lit(b) if isinstance(b, int) else b, F.lit(0)))


def _part(a: Column | int, b: Column | int) -> Column:
    """a b / 255 to the nearest."""
    return _div(a * b + F.lit(127), 255)


def _hard(a: Column, b: Column) -> Column:
    return F.when(a <= 127, _part(a * 2, b)).otherwise(255 - _part((255 - a) * 2, 255 - b))


def _soft(s: Column, d: Column) -> Column:
    curve = F.when(d <= 63, _div(((d * 16 - 3060) * d + 260100) * d, 65025)).otherwise(F.floor(F.sqrt((d * 255).cast("double"))))
    return F.when(s <= 127, d - _part(_part(255 - s * 2, d), 255 - d)).otherwise(d + _part(s * 2 - 255, curve - d))


#: Modes that take each channel by itself: source and destination, not premultiplied.
CHANNELS: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": _part,
    "screen": lambda s, d: s + d - _part(s, d),
    "overlay": lambda s, d: _hard(d, s),
    "darken": F.least,
    "lighten": F.greatest,
    "color_dodge": lambda s, d: F.when(s == 255, F.lit(255)).otherwise(F.least(_div(d * 255, 255 - s), F.lit(255))),
    "color_burn": lambda s, d: F.when(s == 0, F.lit(0)).otherwise(255 - F.least(_div((255 - d) * 255, s), F.lit(255))),
    "hard_light": _hard,
    "soft_light": _soft,
    "difference": lambda s, d: F.abs(s - d),
    "exclusion": lambda s, d: s + d - _part(s, d) * 2,
}
MODES = (*SHARES, "source", "destination", "plus", "modulate", *CHANNELS, *TONES)


def _luma(r: Column, g: Column, b: Column) -> Column:
    return _div(r * 77 + g * 150 + b * 29 + F.lit(128), 256)


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in RGB]


def blended(rows: DataFrame, mode: str) -> DataFrame:
    """Rows with r, g, b, a: source (sr, sg, sb, sa) on destination (dr, dg, db, da) by the mode named in a column; null for an unknown one.

    Each stage is a projection of its own, so that no expression is copied into those that use it several times.
    """
    m, sa, da = F.col(mode), F.col("sa"), F.col("da")
    pick = lambda cases, other=None: F.coalesce(*(F.when(m == name, c) for name, c in cases.items()), *([] if other is None else [other]))
    spread = lambda p: F.greatest(*_cols(p)) - F.least(*_cols(p))
    tinted = lambda c, p, goal: F.coalesce(_div((F.col(f"{p}{c}") - F.least(*_cols(p))) * goal, spread(p)), F.lit(0))

    out = rows.withColumns({f"_p{x}{c}": _part(F.col(f"{x}{c}"), F.col(f"{x}a")) for x in "sd" for c in RGB})
    # tone modes: a base colour is shifted to a lightness, then pulled back into the range around it
    base = {c: pick({"hue": tinted(c, "s", spread("d")), "saturation": tinted(c, "d", spread("s")), "color": F.col(f"s{c}")}, F.col(f"d{c}")) for c in RGB}
    out = out.withColumns({f"_b{c}": e for c, e in base.items()} | {"_goal": F.when(m == "luminosity", _luma(*_cols("s"))).otherwise(_luma(*_cols("d")))})
    out = out.withColumn("_shift", F.col("_goal") - _luma(*_cols("_b"))).withColumns({f"_c{c}": F.col(f"_b{c}") + F.col("_shift") for c in RGB})
    out = out.withColumns({"_l": _luma(*_cols("_c")), "_low": F.least(*_cols("_c")), "_high": F.greatest(*_cols("_c"))})
    light, low, high = F.col("_l"), F.col("_low"), F.col("_high")
    out = out.withColumns({f"_c{c}": F.when(low < 0, light + _div((F.col(f"_c{c}") - light) * light, light - low)).otherwise(F.col(f"_c{c}")) for c in RGB})
    out = out.withColumns({f"_c{c}": F.when(high > 255, light + _div((F.col(f"_c{c}") - light) * (255 - light), high - light)).otherwise(F.col(f"_c{c}")) for c in RGB})
    mixed = lambda c: pick({name: f(F.col(f"s{c}"), F.col(f"d{c}")) for name, f in CHANNELS.items()}, F.least(F.greatest(F.col(f"_c{c}"), F.lit(0)), F.lit(255)))
    out = out.withColumns({f"_m{c}": mixed(c) for c in RGB})
    weigh = {name: tuple(F.lit(w) if isinstance(w, int) else w for w in f(sa, da)) for name, f in SHARES.items()}
    sides = out.withColumns({"_ws": pick({n: w[0] for n, w in weigh.items()}, 255 - da), "_wd": pick({n: w[1] for n, w in weigh.items()}, 255 - sa)})
    meets = m.isin(*CHANNELS, *TONES)
    most = lambda e: F.least(e, F.lit(255))

    def whole(s: Column, d: Column, overlap: Column) -> Column:
        weighed = most(_part(s, F.col("_ws")) + _part(d, F.col("_wd")))
        return F.when(m == "plus", most(s + d)).when(m == "modulate", _part(s, d)).when(meets, most(weighed + overlap)).otherwise(weighed)

    made = sides.withColumns({f"_o{c}": whole(F.col(f"_ps{c}"), F.col(f"_pd{c}"), _part(_part(F.col(f"_m{c}"), sa), da)) for c in RGB} | {"_oa": F.when(meets, most(sa + _part(da, 255 - sa))).otherwise(whole(sa, da, F.lit(0)))})
    same = {"source": "s", "destination": "d"}
    straight = lambda c: most(F.coalesce(_div(F.col(f"_o{c}") * 255 + _div(F.col("_oa"), 2), F.col("_oa")), F.lit(0)))
    kept = lambda c: F.coalesce(*(F.when(m == name, F.when(F.col(f"{x}a") == 0, F.lit(0)).otherwise(F.col(f"{x}{c}"))) for name, x in same.items()))
    result = {c: F.when(m.isin(*MODES), F.coalesce(kept(c), straight(c) if c != "a" else F.col("_oa"))).cast("long") for c in "rgba"}
    return made.withColumns(result).select(*rows.columns, *"rgba")
