"""Point clouds: a row for each point (x, y, z, c, rn, nr, r, g, b); c = 2 is ground."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Every n-th row of each group, starting with its first: not a random sample."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter((c("_rn") - 1) % n == 0).drop("_rn")


def cropped(points: DataFrame, x0: float, y0: float, size: float, pad: float = 4.0) -> DataFrame:
    """Points of a box with a margin, 16-bit colours (r, g, b) brought to 8 bits."""
    inside = (c("x") >= x0 - pad) & (c("x") < x0 + size + pad) & (c("y") >= y0 - pad) & (c("y") < y0 + size + pad)
    rest = [n for n in points.columns if n not in ("r", "g", "b")]
    return points.filter(inside).select(*rest, *[F.shiftright(c(n).cast("int"), 8).alias(n) for n in ("r", "g", "b")])


def cell(points: DataFrame) -> DataFrame:
    return points.withColumn("ix", F.floor("x").cast("long")).withColumn("iz", F.floor("y").cast("long"))


def green(ratio_r: float, ratio_b: float, least: float = -1.0) -> Column:
    return (c("g") > c("r") * ratio_r) & (c("g") > c("b") * ratio_b) & (c("g") > least)


def ground_median(points: DataFrame) -> DataFrame:
    """(ix, iz, h): median height of the ground points of each cell."""
    return cell(points).filter("c = 2").groupBy("ix", "iz").agg(F.median("z").alias("h"))


def voxel_evidence(points: DataFrame, ground: DataFrame, above: float) -> DataFrame:
    """(ix, iz, k, total, non_last, n_green): points over the ground in each 1 m voxel."""
    d = cell(points).filter("c <> 2").join(ground, ["ix", "iz"]).withColumn("up", c("z") - c("h")).filter(c("up") > above)
    return d.groupBy("ix", "iz", F.floor("z").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("total"), F.count_if(c("rn") < c("nr")).alias("non_last"), F.count_if(green(1.04, 1.04)).alias("n_green"), F.max("up").alias("top"))


def column_vegetation(evidence: DataFrame, wall_distance: DataFrame) -> DataFrame:
    """(ix, iz, veg): a column is vegetation if a quarter of at least 3 points is green, or, two cells
    off any wall, at least 20 points in two layers have 40 % non-last returns."""
    g = evidence.groupBy("ix", "iz").agg(F.sum("total").alias("ct"), F.sum("non_last").alias("cn"), F.sum("n_green").alias("cg"), F.count(F.lit(1)).alias("layers"), F.max("top").alias("top"))
    d = g.join(wall_distance, ["ix", "iz"], "left").withColumn("far", F.coalesce("distance", F.lit(1e9)) >= 2)
    seen = F.greatest("ct", F.lit(1))
    veg = ((c("ct") >= 3) & (c("cg") / seen >= 0.25)) | (c("far") & (c("ct") >= 20) & (c("layers") >= 2) & (c("cn") / seen >= 0.40))
    return d.select("ix", "iz", "ct", "layers", "top", veg.alias("veg"))


def roof_heights(points: DataFrame, ground: DataFrame, share: float = 0.8) -> DataFrame:
    """(ix, iz, roof): a percentile of heights over 1 m of points that are not green; null under two."""
    d = cell(points).filter("c <> 2").join(ground, ["ix", "iz"]).withColumn("up", c("z") - c("h")).filter((c("up") > 1.0) & ~green(1.04, 1.04))
    g = d.groupBy("ix", "iz").agg(F.percentile("up", share).alias("p"), F.count(F.lit(1)).alias("n"))
    return g.select("ix", "iz", "n", F.when(c("n") >= 2, c("p")).alias("roof"))


def scatter(points: DataFrame, least: int = 10) -> DataFrame:
    """(ix, iz, k, n, index): the smallest eigenvalue of the points' covariance in a voxel over its
    trace, in closed form: near 0 for planes, up to a third for foliage."""
    d = cell(points).select("ix", "iz", F.floor("z").cast("long").alias("k"), (c("x") - F.floor("x")).alias("u"), (c("y") - F.floor("y")).alias("v"), (c("z") - F.floor("z")).alias("w"))
    g = d.groupBy("ix", "iz", "k").agg(F.count(F.lit(1)).alias("n"), F.var_pop("u").alias("a"), F.var_pop("v").alias("b"), F.var_pop("w").alias("cc"), F.covar_pop("u", "v").alias("d"), F.covar_pop("u", "w").alias("e"), F.covar_pop("v", "w").alias("f")).filter(c("n") >= least)
    smallest = smallest_eigenvalue(*(c(x) for x in ("a", "b", "cc", "d", "e", "f")))
    return g.select("ix", "iz", "k", "n", (smallest / F.greatest(c("a") + c("b") + c("cc"), F.lit(1e-9))).alias("index"))


def smallest_eigenvalue(a: Column, b: Column, cc: Column, d: Column, e: Column, f: Column) -> Column:
    """Of the symmetric matrix [[a, d, e], [d, b, f], [e, f, cc]], by the trigonometric formula."""
    q = (a + b + cc) / 3
    p2 = (a - q) * (a - q) + (b - q) * (b - q) + (cc - q) * (cc - q) + 2 * (d * d + e * e + f * f)
    p = F.sqrt(p2 / 6)
    det = (a - q) * ((b - q) * (cc - q) - f * f) - d * (d * (cc - q) - f * e) + e * (d * f - (b - q) * e)
    r = F.least(F.greatest(det / (2 * p * p * p), F.lit(-1.0)), F.lit(1.0))
    return F.when(p2 < 1e-24, q).otherwise(q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3))


def street_axis(points: DataFrame, key: str) -> DataFrame:
    """(key, theta): direction of the largest spread, turned to point east."""
    g = points.groupBy(key).agg(F.var_samp("x").alias("a"), F.covar_samp("x", "y").alias("b"), F.var_samp("y").alias("cc"))
    return g.select(key, (0.5 * F.atan2(2 * c("b"), c("a") - c("cc"))).alias("theta"))


def pole_bins(points: DataFrame, ground: DataFrame) -> DataFrame:
    """(fu, fv, layers, top): thin standing columns on a 0.25 m grid of 0.5 m layers. A bin with three
    points counts; it is thin if at most 9 of the 81 bins around it in its layer count; a candidate has
    7 thin layers from 1.5 m to 8 m."""
    d = cell(points).join(ground, ["ix", "iz"]).withColumn("up", c("z") - c("h")).filter((c("up") > 0.4) & (c("up") < 14))
    occ = d.groupBy(F.floor(c("x") / 0.25).cast("long").alias("fu"), F.floor(c("y") / 0.25).cast("long").alias("fv"), F.floor(c("up") / 0.5).cast("long").alias("fh")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3 AND fh < 28")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("du"), F.lit(j).alias("dv")) for i in range(-4, 5) for j in range(-4, 5)]))
    around = occ.select("fh", "fu", "fv", steps.alias("o")).select("fh", (c("fu") + c("o.du")).alias("fu"), (c("fv") + c("o.dv")).alias("fv")).groupBy("fh", "fu", "fv").agg(F.count(F.lit(1)).alias("near"))
    thin = occ.join(around.filter("near <= 9"), ["fh", "fu", "fv"])
    g = thin.groupBy("fu", "fv").agg(F.count_if((c("fh") >= 3) & (c("fh") < 16)).alias("layers"), ((F.max("fh") + 1) * 0.5).alias("top"))
    return g.filter("layers >= 7")


def poles(bins: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, u, v, top): components of candidate bins that are no wide blobs and at least 4 m tall.
    ``labels``: (x, z, label) of bins as cells."""
    d = bins.join(labels.select(c("x").alias("fu"), c("z").alias("fv"), "label"), ["fu", "fv"])
    g = d.groupBy("label").agg(F.count(F.lit(1)).alias("n"), ((F.avg("fu") + 0.5) * 0.25).alias("u"), ((F.avg("fv") + 0.5) * 0.25).alias("v"), F.max("top").alias("top"))
    return g.filter("n <= 40 AND top >= 4.0")


def canopy_fill(tops: DataFrame, ground: DataFrame, share: float = 0.45) -> DataFrame:
    """(x, z, y): vegetation columns filled down to a share of the canopy's height, and to the ground
    under a local maximum of 5 x 5. ``tops``: (x, z, top); ``ground``: (x, z, surf)."""
    from gridspan.operators.grid import neighbourhood

    peak = neighbourhood(tops.select("x", "z", c("top").alias("v")), 2, F.max("w")).select("x", "z", c("out").alias("peak"))
    d = tops.join(ground, ["x", "z"]).join(peak, ["x", "z"]).withColumn("t", c("top") - c("surf")).filter("t >= 1")
    low = F.when(c("t") <= 3, c("surf") + 1).otherwise(c("surf") + F.floor(c("t") * share))
    low = F.when((c("top") == c("peak")) & (c("t") > 3), c("surf") + 1).otherwise(low)
    return d.select("x", "z", F.explode(F.sequence(low, c("top"))).alias("y"))
