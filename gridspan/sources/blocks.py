"""Block worlds: sections of 4,096 blocks as a palette and packed indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Block names by what they stand for.
ROAD = ["gray_concrete_powder", "cyan_terracotta", "black_concrete"]
FOOTWAY = ["gray_concrete", "smooth_stone", "dirt_path"]
PLANTS = ["short_grass", "tall_grass", "fern", "dandelion", "poppy", "blue_orchid", "azure_bluet", "allium", "oxeye_daisy", "cornflower", "lily_of_the_valley", "dead_bush", "flower_pot", "sweet_berry_bush"]
LAMP_PARTS = ["smooth_stone", "stone_brick_wall", "redstone_lamp", "iron_trapdoor"]
FENCE_HINTS = ["fence", "_wall", "iron_bars"]
LEAFY = ["vine", "moss_block", "mangrove_roots"]


def index_bits(palette_size: Column) -> Column:
    """Bits of an index: at least four."""
    return F.greatest(F.lit(4), F.length(F.bin((palette_size - 1).cast("long"))))


def section_blocks(sections: DataFrame) -> DataFrame:
    """(cx, cz, sy, y, z, x, name) of sections (cx, cz, sy, palette, data array<long>): indices do not
    straddle longs; a section without data is all its first palette entry."""
    per = F.floor(F.lit(64) / F.col("bits")).cast("int")
    d = sections.withColumn("bits", index_bits(F.size("palette"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4095))))
    plain = F.col("data").isNull() | (F.size("palette") == 1)
    word = F.try_element_at("data", (F.floor(F.col("i") / per) + 1).cast("int"))
    shift = (F.col("i") % per) * F.col("bits")
    # an unsigned shift by a column
    index = F.expr("shiftrightunsigned(_word, _shift)").bitwiseAND((F.pow(F.lit(2), F.col("bits")) - 1).cast("long"))
    d = d.withColumn("_word", word).withColumn("_shift", shift.cast("int")).withColumn("_at", F.when(plain, F.lit(0).cast("long")).otherwise(index))
    name = F.regexp_replace(F.element_at("palette", (F.col("_at") + 1).cast("int")), "^minecraft:", "")
    return d.select("cx", "cz", "sy", F.shiftright("i", 8).alias("y"), F.shiftright("i", 4).bitwiseAND(F.lit(15)).alias("z"), F.col("i").bitwiseAND(F.lit(15)).alias("x"), name.alias("name"))


def block_kind(name: Column) -> Column:
    """air, solid, veg, fence or lamp."""
    leafy = name.endswith("_log") | name.endswith("_leaves") | name.isin(LEAFY)
    hint = F.lit(False)
    for h in FENCE_HINTS:
        hint = hint | name.contains(h)
    return F.when((name == "air") | name.isin(PLANTS), "air").when(leafy, "veg").when(hint & (name != "stone_brick_wall"), "fence").when(name.isin(LAMP_PARTS), "lamp").otherwise("solid")


def surface_class(name: Column) -> Column:
    return F.when(name.isin(ROAD), 2).when(name.isin(FOOTWAY), 3).otherwise(1)
