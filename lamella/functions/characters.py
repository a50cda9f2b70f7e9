"""Character codes, single-byte text, hashes of names, strict numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The single-byte table is code page 1252 with a bullet where that has nothing (and at 7F), a space at A0 and a hyphen at AD.
HIGH = [0x7F, *range(0x80, 0xA1), 0xAD]
WINANSI = {b: "•" if b in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x95) else " " if b == 0xA0 else "-" if b == 0xAD else bytes([b]).decode("cp1252") for b in HIGH}
# The 64-bit hash of names (FNV-1a).
BASIS, PRIME, WRAP = 14695981039346656037, 1099511628211, 1 << 64


def winansi(data: Column) -> Column:
    """Text of single bytes; null where a control code has no character."""
    plain = F.decode(data, "ISO-8859-1")
    return F.when(~plain.rlike("[\\x00-\\x1f]"), F.translate(plain, "".join(map(chr, WINANSI)), "".join(WINANSI.values())))


def codes(data: Column, size: int) -> Column:
    """Big-endian codes of `size` bytes each; null if the bytes do not come out even."""
    digits, n = F.hex(data), F.octet_length(data)
    one = lambda i: F.conv(F.substr(digits, (i * (2 * size) + 1).cast("int"), F.lit(2 * size)), 16, 10).cast("int")
    none = F.array().cast("array<int>")
    return F.when(n == 0, none).when(n % size == 0, F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int") - 1), one))


def name_hash(data: Column) -> Column:
    """The hash as a whole decimal from 0 to 2^64 - 1: products have at most 34 digits, so nothing wraps by itself."""
    wide = lambda v: F.lit(str(v)).cast("decimal(20,0)")

    def step(h: Column, byte: Column) -> Column:
        low = F.pmod(h, wide(256)).cast("int")
        mixed = (h - low.cast("decimal(20,0)") + low.bitwiseXOR(byte).cast("decimal(20,0)")).cast("decimal(20,0)")
        return F.pmod((mixed * F.lit(str(PRIME)).cast("decimal(14,0)")).cast("decimal(35,0)"), wide(WRAP)).cast("decimal(20,0)")

    return F.aggregate(codes(data, 1), wide(BASIS), step)


def scene_scalar(text: Column) -> Column:
    """Billionths of a plain decimal with at most nine fraction digits, as far as they fit 64 bits; null for anything else, exponents included."""
    plain = F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]{0,9}|\.[0-9]{1,9})$"), text)
    units = (plain.try_cast("decimal(28,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.when(units.between(F.lit(str(-(1 << 63))).cast("decimal(38,0)"), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")), units)


def output_height(width: Column, height: Column, rotation: Column, pixels: Column, limit: int) -> Column:
    """Rows of pixels for so many columns of a page, to the nearest; null for none or more than the limit."""
    turned = rotation.isin(90, 270)
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    rows = F.floor((pixels * h + F.floor(w / 2)) / F.nullif(w, F.lit(0))).cast("long")
    return F.when(rows.between(1, limit), rows)


def filter_plan(filters: Column, parms: Column) -> Column:
    """Filters paired with their parameters: none at all stand for null each; another count than that of filters gives null."""
    nothing = F.transform(filters, lambda _: F.lit(None).cast("int"))
    given = F.when(parms.isNull(), nothing).when(F.size(parms) == F.size(filters), parms)
    return F.when(given.isNotNull(), F.zip_with(filters, given, lambda f, p: F.struct(f.alias("filter"), F.coalesce(p, F.lit(1)).alias("predictor"))))
