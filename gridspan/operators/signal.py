"""Sampled signals as rows (track, i, v): gains, loops, levels; and pixels through a dither matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def decibels(mean_square: Column) -> Column:
    return 10 * F.log10(mean_square + 1e-12)


def levels(x: DataFrame, key: str) -> DataFrame:
    """RMS and peak in decibels, and the mean step from sample to sample, of every track."""
    w = Window.partitionBy(key).orderBy("i")
    d = x.withColumn("step", F.abs(F.col("v") - F.lag("v").over(w)))
    return d.groupBy(key).agg(decibels(F.avg(F.col("v") * F.col("v"))).alias("rms_db"), (20 * F.log10(F.max(F.abs("v")) + 1e-12)).alias("peak_db"), F.avg("step").alias("mean_step"), F.abs(F.max_by("v", "i") - F.min_by("v", "i")).alias("seam"))


def fold_loop(x: DataFrame, key: str, fade: int) -> DataFrame:
    """The track without its last ``fade`` samples, which are mixed into the first with equal power."""
    w = Window.partitionBy(key)
    n = F.count(F.lit(1)).over(w)
    target = F.when(F.col("i") >= n - fade, F.col("i") - (n - fade)).otherwise(F.col("i"))
    angle = (target + 0.5) / fade * (math.pi / 2)
    weight = F.when(F.col("i") >= n - fade, F.cos(angle)).when(F.col("i") < fade, F.sin(angle)).otherwise(F.lit(1.0))
    return x.select(key, target.alias("i"), (F.col("v") * weight).alias("v")).groupBy(key, "i").agg(F.sum("v").alias("v"))


def levelled(x: DataFrame, key: str, half: int, most_db: float = 9.0) -> DataFrame:
    """Moving-average level about its own median, limited to +-most_db, as a gain on each sample."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(-half, half)
    d = x.withColumn("level", decibels(F.avg(F.col("v") * F.col("v")).over(w)))
    mid = d.groupBy(key).agg(F.median("level").alias("mid"))
    off = F.least(F.greatest(F.col("mid") - F.col("level"), F.lit(-most_db)), F.lit(most_db))
    return d.join(mid, key).select(key, "i", (F.col("v") * gain(off)).alias("v"), off.alias("gain_db"))


def bayer_rank(x: Column, z: Column) -> Column:
    """0..15 of a cell in the 4 x 4 ordered-dither matrix, by its recursive rule."""
    bit = lambda v, b: F.shiftright(v.cast("int"), b).bitwiseAND(F.lit(1))
    mixed = lambda b: bit(x, b).bitwiseXOR(bit(z, b)) * 2 + bit(z, b)
    return mixed(0) * 4 + mixed(1)


def credits(windows: DataFrame, key: str) -> DataFrame:
    """(kind, source, ranges): the ranges of all windows of a source, each once, in first-seen order."""
    w = Window.partitionBy("kind", "source", "range").orderBy(key, "pos")
    first = windows.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return first.groupBy("kind", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "pos", "range"))), lambda s: s["range"]).alias("ranges"))
