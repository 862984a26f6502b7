"""Archive listings: lines of "size compressed crc name"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspan.operators.osm import first_per_key


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(ward, line) of text files, the ward being the file's name."""
    return spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("ward"), F.col("value").alias("line"))


def parse_listing(lines: DataFrame) -> DataFrame:
    """(ward, size, comp, crc, name); names may hold spaces; other lines are dropped."""
    p = F.split("line", " ", 4)
    d = lines.select("ward", p.alias("p")).filter(F.size("p") == 4)
    return d.select("ward", F.col("p")[0].try_cast("long").alias("size"), F.col("p")[1].try_cast("long").alias("comp"), F.col("p")[2].alias("crc"), F.col("p")[3].alias("name")).filter("size IS NOT NULL AND comp IS NOT NULL")


def planned_members(listing: DataFrame, kinds: list[str]) -> DataFrame:
    """Members udx/<kind>/<mesh>_..._op.gml of the wanted kinds; the same member (name, size, crc) of
    several wards belongs to the first of them."""
    part = F.split("name", "/")
    d = listing.filter((F.size(part) == 3) & (part[0] == "udx") & part[1].isin(kinds) & F.col("name").endswith("_op.gml"))
    d = d.withColumn("kind", part[1]).withColumn("mesh", F.split_part(part[2], F.lit("_"), F.lit(1)))
    return first_per_key(d, ["name", "size", "crc"], ["ward"])


def largest_first(files: DataFrame, lanes: int) -> DataFrame:
    """``files`` (name, size and others) with rank and lane: the largest begin first (ties by name), dealt to
    the lanes there and back, so that lanes end about together. A listing's rows, not the files' contents."""
    nth = F.row_number().over(Window.orderBy(F.col("size").desc(), "name")) - 1
    turn = F.pmod(nth, F.lit(2 * lanes))
    return files.withColumn("rank", nth.cast("long")).withColumn("lane", F.when(turn < lanes, turn).otherwise(2 * lanes - 1 - turn).cast("long"))
