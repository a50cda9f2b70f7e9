"""Corpus manifests and pixel artifacts as tables and files."""

from __future__ import annotations

import json
import struct
import tomllib
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a manifest entry.
MANIFEST = "sha256 string, path string, tier string, page_count long, license_expression string, features array<string>"


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a manifest, features sorted and without repeats; a repeated digest is an error."""
    entries = tomllib.loads(text).get("entry", [])
    if len({e["sha256"] for e in entries}) != len(entries):
        raise ValueError("duplicate sha256")
    return spark.createDataFrame([(e["sha256"], e["path"], e["tier"], e["page_count"], e["license_expression"], sorted(set(e.get("features", [])))) for e in entries], MANIFEST)


def manifest_lines(entries: DataFrame) -> DataFrame:
    """One canonical line an entry, fields in fixed order; sort by `sha256` when writing."""
    return entries.select("sha256", F.to_json(F.struct("sha256", "path", "tier", "page_count", "license_expression", F.array_sort(F.array_distinct("features")).alias("features"))).alias("line"))


def verify(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Each entry against objects (path, content): ready, missing or mismatch."""
    joined = entries.join(objects.select("path", "content"), "path", "left")
    outcome = F.when(F.col("content").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "mismatch").otherwise("ready")
    return joined.select("sha256", "path", outcome.alias("outcome"))


def pixels(line: Column) -> Column:
    """A pixel artifact (JSON with width, height, rgba_hex) as a struct with bytes; null if the sizes disagree."""
    p = F.from_json(line, "width int, height int, rgba_hex string")
    return F.when(F.length(p["rgba_hex"]) == p["width"] * p["height"] * 8, F.struct(p["width"].alias("width"), p["height"].alias("height"), F.unhex(p["rgba_hex"]).alias("rgba")))


def pixel_line(width: int, height: int, rgba: bytes) -> str:
    return json.dumps({"height": height, "rgba_hex": rgba.hex(), "width": width}, sort_keys=True, separators=(",", ":"))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """A PNG file of 8-bit RGBA rows, unfiltered."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    if len(rgba) != width * height * 4:
        raise ValueError("size")
    rows = b"".join(b"\0" + rgba[k : k + 4 * width] for k in range(0, len(rgba), 4 * width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
