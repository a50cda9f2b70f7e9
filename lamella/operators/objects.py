"""Places of objects, checks over revision chains, code tables of fonts, differences of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def locators(entries: DataFrame) -> DataFrame:
    """The place of every object in use: its own offset, or its container's offset and its index in there.

    entries: doc, object, kind ('free', 'plain' or 'packed'), offset, container, index. A container has to be a plain entry of the same document.
    """
    holders = entries.where("kind = 'plain'").select("doc", F.col("object").alias("container"), F.col("offset").alias("_at"))
    packed = F.col("kind") == "packed"
    place = F.when(packed, F.col("_at")).otherwise(F.col("offset"))
    outcome = F.when(place.isNull(), "container-missing").otherwise("ready")
    placed = entries.where("kind <> 'free'").join(holders, ["doc", "container"], "left")
    return placed.select("doc", "object", "kind", place.alias("place"), F.when(packed, F.col("index")).alias("index"), outcome.alias("outcome"))


def chain_faults(revisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (doc, fault, at) for repeated anchors, free entries that point outside, and roots that are no live entry of their generation.

    revisions: doc, revision, anchor, size, root, root_generation; entries: doc, object, generation, kind, next_free. Size and root are those of the newest revision.
    """
    fault = lambda d, name, at: d.select("doc", F.lit(name).alias("fault"), F.col(at).cast("long").alias("at"))
    anchors = revisions.groupBy("doc", "anchor").count().where("count > 1")
    newest = revisions.groupBy("doc").agg(F.max_by(F.struct("size", "root", "root_generation"), "revision").alias("n")).select("doc", "n.*")
    free = entries.where("kind = 'free'").join(newest, "doc").where("next_free >= size")
    live = entries.where("kind <> 'free'").select("doc", F.col("object").alias("root"), "generation")
    roots = newest.join(live, ["doc", "root"], "left")
    return (
        fault(anchors, "anchor-repeats", "anchor")
        .union(fault(free, "free-out-of-bounds", "object"))
        .union(fault(roots.where("generation is null"), "root-not-live", "root"))
        .union(fault(roots.where("generation <> root_generation"), "root-generation", "root"))
    )


def cmap_glyphs(codes: DataFrame, segments: DataFrame) -> DataFrame:
    """The glyph of each (font, code) by the first segment (font, ordinal, seg_start, seg_end, delta) that ends at or after it; 0 outside.

    Codes and segments are sorted together once, from high to low, and each code takes the segment met last: no range join. Segments count by delta alone.
    """
    mine = codes.select("font", F.col("code").alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_ordinal"), F.lit(None).cast("struct<s:bigint,d:bigint>").alias("_seg"))
    theirs = segments.select("font", F.col("seg_end").alias("_at"), F.lit(1).alias("_side"), F.col("ordinal").cast("long").alias("_ordinal"), F.struct(F.col("seg_start").cast("long").alias("s"), F.col("delta").cast("long").alias("d")).alias("_seg"))
    down = Window.partitionBy("font").orderBy(F.desc("_at"), F.desc("_side"), F.desc("_ordinal")).rowsBetween(Window.unboundedPreceding, 0)
    met = mine.unionByName(theirs).withColumn("_hit", F.last("_seg", ignorenulls=True).over(down)).where("_side = 0")
    glyph = F.when(F.col("_at") >= F.col("_hit.s"), F.pmod(F.col("_at") + F.col("_hit.d"), F.lit(65536))).otherwise(F.lit(0))
    return met.select("font", F.col("_at").alias("code"), F.coalesce(glyph, F.lit(0)).cast("long").alias("glyph"))


def code_widths(codes: DataFrame, fonts: DataFrame, widths: DataFrame) -> DataFrame:
    """Width of each (font, code): the font's default for an unknown code of an identity font, null for one of a simple font."""
    found = codes.join(fonts, "font").join(widths, ["font", "code"], "left")
    return found.withColumn("width", F.when(F.col("kind") == "identity", F.coalesce("width", "default_width")).otherwise(F.col("width")))


def scene_totals(expected: DataFrame, actual: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Removed, added and changed places of two scenes by key; more differences than the limit are an outcome, never a shorter list."""
    left, right = expected.withColumn("_e", F.struct(value)).drop(value), actual.withColumn("_a", F.struct(value)).drop(value)
    met = left.join(right, keys, "full").groupBy(*keys[:-1])
    counts = met.agg(
        F.count_if(F.col("_a").isNull()).alias("removed"),
        F.count_if(F.col("_e").isNull()).alias("added"),
        F.count_if(F.col("_a").isNotNull() & F.col("_e").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_e"))).alias("changed"),
    )
    return counts.withColumn("outcome", F.when(F.col("removed") + F.col("added") + F.col("changed") > limit, "difference-limit").otherwise("ready"))


def supports(capability: Column, parameter: Column) -> Column:
    """Whether a capability is there for its parameter. The values are those of the data model."""
    parts, bits = F.pmod(parameter, F.lit(256)), F.pmod(F.shiftright(parameter, 8), F.lit(256))
    rules = {
        "fill": parameter <= 1, "clip": parameter <= 1, "stroke": parameter == 0, "color": parameter.isin(1, 3, 4), "alpha": parameter <= 65535,
        "blend": parameter.between(0, 2), "image": (F.shiftright(parameter, 16) == 0) & parts.isin(1, 3, 4) & (bits == 8), "glyph": parameter != 0,
    }
    return F.coalesce(*(F.when(capability == name, rule) for name, rule in rules.items()), F.lit(False))
