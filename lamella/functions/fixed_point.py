"""Whole-number arithmetic: scaled decimals, 16-bit colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000_000
ONE = 65536


def scaled(value: Column) -> Column:
    """A number as billionths, half away from zero."""
    return F.round(value.cast("decimal(28,12)") * F.lit(SCALE).cast("decimal(10,0)"), 0).cast("decimal(19,0)")


def divide_half_away(n: Column, d: int) -> Column:
    """n / d to the nearest whole number, halves away from zero."""
    whole = F.lit(d).cast("decimal(19,0)")
    twice = F.abs(n) * 2 + whole
    # without the remainder the quotient is whole: a decimal one has six places and would round up to the next
    up = (twice - twice % (whole * 2)) / (whole * 2)
    return (F.signum(n).cast("decimal(1,0)") * up).cast("decimal(19,0)")


def affine(x: Column, y: Column, a: int, c: int, e: int) -> Column:
    """a x + c y + e of billionths, rounded once."""
    wide = lambda k: F.lit(k).cast("decimal(19,0)")
    products = (x * wide(a)).cast("decimal(37,0)") + (y * wide(c)).cast("decimal(37,0)")
    return divide_half_away(products.cast("decimal(37,0)"), SCALE) + wide(e)


def _over(n: Column, d: int) -> Column:
    return F.floor((n + d // 2) / d).cast("long")


def q16(byte: Column) -> Column:
    """0..255 as 0..65536, to the nearest."""
    return _over(byte.cast("long") * ONE, 255)


def multiply(source: Column, backdrop: Column) -> Column:
    return _over(source * backdrop, ONE)


def screen(source: Column, backdrop: Column) -> Column:
    return source + backdrop - _over(source * backdrop, ONE)


def normal_over(source: Column, backdrop: Column, alpha: Column) -> Column:
    """Premultiplied source over backdrop."""
    return source + _over(backdrop * (ONE - alpha), ONE)


def rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270; null for what is no quarter turn."""
    return F.when(F.pmod(degrees, F.lit(90)) == 0, F.pmod(degrees, F.lit(360)))
