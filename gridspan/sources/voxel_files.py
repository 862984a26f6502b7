"""Voxel files: one byte a cell, x fastest, then z, then y, with metadata beside; and layer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.operators.grid import CLASS_NAMES, class_histogram

c = F.col


def byte_cells(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, i, value): every byte of a binary column, unsigned."""
    d = files.select(key, F.hex(data).alias("_h"), F.posexplode(F.sequence(F.lit(0), F.length(data) - 1)).alias("i", "_k"))
    return d.select(key, c("i").cast("long").alias("i"), F.conv(F.substr("_h", c("_k") * 2 + 1, F.lit(2)), 16, 10).cast("long").alias("value"))


def read_voxels(spark: SparkSession, path: str, nx: int, ny: int, nz: int) -> DataFrame:
    """(file, x, y, z, cls) of the solid cells of raw files; a file of another length is an error."""
    f = spark.read.format("binaryFile").load(path).select(c("path").alias("file"), "content", "length")
    wrong = F.concat(c("file"), F.lit(" has "), c("length").cast("string"), F.lit(f" bytes, not {nx * ny * nz}"))
    f = f.select("file", F.when(c("length") == nx * ny * nz, c("content")).otherwise(F.raise_error(wrong)).alias("content"))
    b = byte_cells(f, "file", "content").filter("value > 0")
    return b.select("file", (c("i") % nx).alias("x"), F.floor(c("i") / (nx * nz)).alias("y"), (F.floor(c("i") / nx) % nz).alias("z"), c("value").alias("cls"))


def write_voxels(voxels: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Write cells (x, y, z, cls) and a metadata table with their counts by class name."""
    voxels.select(*[c(n).cast("int").alias(n) for n in ("x", "y", "z")], c("cls").cast("smallint").alias("cls")).write.parquet(f"{path}/cells")
    spark = voxels.sparkSession
    counts = class_histogram(spark.read.parquet(f"{path}/cells"), [])
    name = F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), (c("cls") + 1).cast("int"))
    m = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), c("n"))))).alias("classCounts"))  # 13 rows
    m.select(*[F.lit(v).alias(k) for k, v in meta.items()], "classCounts").write.json(f"{path}/meta")


LAYERS = "x INT, z INT, h FLOAT, w FLOAT, rc SMALLINT, rc_lod SMALLINT, bh FLOAT, deck FLOAT, cover BOOLEAN"


def write_layers(layers: DataFrame, path: str, supertile: int = 512) -> None:
    """Layers by supertile, whole supertiles replaced: a window reads only the tiles that it needs."""
    names = [f.split()[0] for f in LAYERS.split(", ")]
    d = layers.select(*names, F.floor(c("x") / supertile).cast("int").alias("sx"), F.floor(c("z") / supertile).cast("int").alias("sz"))
    d.repartition("sx", "sz").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sx", "sz").parquet(path)


def read_layer_window(spark: SparkSession, path: str, x0: int, x1: int, z0: int, z1: int, supertile: int = 512) -> DataFrame:
    """Cells of a window; partitions outside it are pruned."""
    d = spark.read.parquet(path)
    tiles = c("sx").between(x0 // supertile, (x1 - 1) // supertile) & c("sz").between(z0 // supertile, (z1 - 1) // supertile)
    return d.filter(tiles & (c("x") >= x0) & (c("x") < x1) & (c("z") >= z0) & (c("z") < z1))
