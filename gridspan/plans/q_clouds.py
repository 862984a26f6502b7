"""Queries of point clouds and sampled signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.operators import graph, grid, points, signal
from gridspan.plans.registry import Tables, out, query

c = F.col

_G = "ground AS (SELECT floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iz, median(z) AS h FROM point WHERE c = 2 GROUP BY 1, 2)"


@query("a04_s12_ground_medians", f"WITH {_G} SELECT ix, iz, round(h, 6) AS h FROM ground", ("point",))
def a04(t: Tables) -> DataFrame:
    """Median ground height of each cell."""
    return out(points.ground_median(t.point), ix="long", iz="long", h="round6")


@query("a05_roof_percentiles", f"WITH {_G}, u AS (SELECT floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iz, z - h AS up FROM point JOIN ground ON ix = floor(x) AND iz = floor(y) WHERE c <> 2 AND NOT (g > r * 1.04 AND g > b * 1.04)) SELECT ix, iz, count(*) AS n, round(quantile_cont(up, 0.8), 6) AS roof FROM u WHERE up > 1.0 GROUP BY 1, 2 HAVING count(*) >= 2", ("point",))
def a05(t: Tables) -> DataFrame:
    """80th percentile of heights that are not green, of at least two."""
    d = points.roof_heights(t.point, points.ground_median(t.point)).filter("roof IS NOT NULL")
    return out(d, ix="long", iz="long", n="long", roof="round6")


_EV = f"""{_G}, e AS (SELECT floor(x)::BIGINT AS ix, floor(y)::BIGINT AS iz, floor(z)::BIGINT AS k, rn, nr, r, g, b, z - h AS up FROM point JOIN ground ON ix = floor(x) AND iz = floor(y) WHERE c <> 2),
    ev AS (SELECT ix, iz, k, count(*) AS total, count(CASE WHEN rn < nr THEN 1 END) AS non_last, count(CASE WHEN g > r * 1.04 AND g > b * 1.04 THEN 1 END) AS n_green, max(up) AS top FROM e WHERE up > 0.7 GROUP BY 1, 2, 3)"""


@query("a06_f14_a24_voxel_evidence", f"WITH {_EV} SELECT ix, iz, k, total, non_last, n_green, round(top, 6) AS top FROM ev", ("point",))
def a06(t: Tables) -> DataFrame:
    """Points, non-last returns and green points in each voxel, and the highest."""
    return out(points.voxel_evidence(t.point, points.ground_median(t.point), 0.7), ix="long", iz="long", k="long", total="long", non_last="long", n_green="long", top="round6")


@query(
    "f15_vegetation_columns",
    f"""WITH {_EV}, g2 AS (SELECT ix, iz, sum(total) AS ct, sum(non_last) AS cn, sum(n_green) AS cg, count(*) AS layers FROM ev GROUP BY 1, 2) SELECT ix, iz, ct::BIGINT AS ct, layers, ((ct >= 3 AND cg / ct::DOUBLE >= 0.25) OR (NOT (ix % 6 = 0) AND ct >= 20 AND layers >= 2 AND cn / ct::DOUBLE >= 0.4)) AS veg FROM g2""",
    ("point",),
)
def f15(t: Tables) -> DataFrame:
    """Which columns are vegetation: green, or many returns away from walls."""
    e = points.voxel_evidence(t.point, points.ground_median(t.point), 0.7)
    wall = e.select("ix", "iz").distinct().withColumn("distance", F.when(c("ix") % 6 == 0, 0.0).otherwise(3.0))
    return out(points.column_vegetation(e, wall), ix="long", iz="long", ct="long", layers="long", veg="boolean")


@query(
    "a07_scatter_index",
    """WITH q AS (SELECT floor(x / 8)::BIGINT AS ix, floor(y / 8)::BIGINT AS iz, floor(z / 8)::BIGINT AS k, x / 8 - floor(x / 8) AS u, y / 8 - floor(y / 8) AS v, z / 8 - floor(z / 8) AS w FROM point),
    s AS (SELECT ix, iz, k, count(*) AS n, var_pop(u) AS a, var_pop(v) AS b, var_pop(w) AS cc, covar_pop(u, v) AS d, covar_pop(u, w) AS e, covar_pop(v, w) AS f FROM q GROUP BY 1, 2, 3 HAVING count(*) >= 10),
    p AS (SELECT *, (a + b + cc) / 3 AS m FROM s), p2 AS (SELECT *, sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(cc - m, 2) + 2 * (d * d + e * e + f * f)) / 6) AS pp FROM p),
    r AS (SELECT *, least(1, greatest(-1, ((a - m) * ((b - m) * (cc - m) - f * f) - d * (d * (cc - m) - f * e) + e * (d * f - (b - m) * e)) / (2 * pp * pp * pp))) AS r FROM p2)
    SELECT ix, iz, k, n, round((m + 2 * pp * cos(acos(r) / 3 + 2 * pi() / 3)) / (a + b + cc), 5) AS idx FROM r""",
    ("point",),
)
def a07(t: Tables) -> DataFrame:
    """Smallest eigenvalue of the points' covariance over its trace, in blocks of eight."""
    p = t.point.select((c("x") / 8).alias("x"), (c("y") / 8).alias("y"), (c("z") / 8).alias("z"))
    return out(points.scatter(p).withColumnRenamed("index", "idx"), ix="long", iz="long", k="long", n="long", idx="round5")


@query("a08_street_axes", "SELECT c, round(0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y)), 6) AS theta FROM point GROUP BY 1", ("point",))
def a08(t: Tables) -> DataFrame:
    return out(points.street_axis(t.point, "c"), c="long", theta="round6")


@query(
    "f16_j23_hit_footprints",
    """WITH s AS (SELECT x, z, count(*) AS n, max(y) AS top FROM voxel GROUP BY 1, 2), f AS (SELECT x // 4 * 1000 + z // 4 AS foot, x, z FROM s), h AS (SELECT foot, quantile_cont(top, 0.85) AS p, count(*) AS hits FROM f JOIN s USING (x, z) WHERE n >= 3 GROUP BY 1 HAVING count(*) >= 3)
    SELECT foot, hits, greatest(3, floor(p))::BIGINT AS height FROM h""",
    ("voxel",),
)
def f16(t: Tables) -> DataFrame:
    """Footprints that the scanner hit, with the 85th percentile of their tops."""
    s = t.voxel.groupBy("x", "z").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("top")).filter("n >= 3")
    f = s.groupBy((F.floor(c("x") / 4) * 1000 + F.floor(c("z") / 4)).alias("foot")).agg(F.percentile("top", 0.85).alias("p"), F.count(F.lit(1)).alias("hits")).filter("hits >= 3")
    return out(f.select("foot", "hits", F.greatest(F.lit(3), F.floor("p")).alias("height")), foot="long", hits="long", height="long")


@query("g05_pole_candidates", """WITH p AS (SELECT (s_suppkey * 7 % 90) + 0.1 AS x, (s_suppkey * 13 % 90) + 0.6 AS y, k * 0.25 + 0.45 AS z FROM supplier, (SELECT unnest(range(0, 34)) AS k), (SELECT unnest(range(0, 3))))
    SELECT DISTINCT floor(x / 0.25)::BIGINT AS fu, floor(y / 0.25)::BIGINT AS fv, 13::BIGINT AS layers, 9.0::DOUBLE AS top FROM p""")
def g05(t: Tables) -> DataFrame:
    """Thin standing columns on a 0.25 m grid."""
    k = F.explode(F.sequence(F.lit(0), F.lit(33)))
    s = t.supplier.withColumn("k", k).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    p = s.select(((c("s_suppkey") * 7 % 90) + 0.1).alias("x"), ((c("s_suppkey") * 13 % 90) + 0.6).alias("y"), (c("k") * 0.25 + 0.45).alias("z"))
    ground = p.select(F.floor("x").alias("ix"), F.floor("y").alias("iz"), F.lit(0.0).alias("h")).distinct()
    return out(points.pole_bins(p, ground), fu="long", fv="long", layers="long", top="double")


@query(
    "g05_poles",
    """WITH p AS (SELECT DISTINCT (s_suppkey * 7 % 90) AS x, (s_suppkey * 13 % 90) AS y, s_suppkey % 3 AS wide FROM supplier), w AS (SELECT x, y, max(wide) AS wide FROM p GROUP BY 1, 2)
    SELECT (x * 4 * 1048576 + y * 4 + 2)::BIGINT AS label, (1 + wide)::BIGINT AS n, round((x * 4 + wide / 2.0 + 0.5) * 0.25, 6) AS u, round((y * 4 + 2 + 0.5) * 0.25, 6) AS v, 9.0::DOUBLE AS top FROM w""",
)
def g05_poles(t: Tables) -> DataFrame:
    """Candidate bins to poles by their components: posts one to three bins wide."""
    k = c("s_suppkey")
    s = t.supplier.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(33)))).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), k % 3)))
    p = s.select(((k * 7 % 90) + 0.1 + c("step") * 0.25).alias("x"), ((k * 13 % 90) + 0.6).alias("y"), (c("k") * 0.25 + 0.45).alias("z"))
    ground = p.select(F.floor("x").alias("ix"), F.floor("y").alias("iz"), F.lit(0.0).alias("h")).distinct()
    bins = points.pole_bins(p, ground)
    labels = graph.cell_components(bins.select(c("fu").alias("x"), c("fv").alias("z")), diagonal=True)
    return out(points.poles(bins, labels), label="long", n="long", u="round6", v="round6", top="double")


@query(
    "w17_canopy_columns",
    """WITH t AS (SELECT x, z, max(y) AS top FROM voxel WHERE cls = 6 GROUP BY 1, 2), g AS (SELECT x, z, min(y) % 3 AS surf FROM voxel GROUP BY 1, 2), p AS (SELECT a.x, a.z, max(b.top) AS peak FROM t a JOIN t b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND b.z BETWEEN a.z - 2 AND a.z + 2 GROUP BY 1, 2),
    d AS (SELECT x, z, top, surf, peak, top - surf AS h FROM t JOIN g USING (x, z) JOIN p USING (x, z) WHERE top - surf >= 1), l AS (SELECT *, CASE WHEN top = peak AND h > 3 THEN surf + 1 WHEN h <= 3 THEN surf + 1 ELSE surf + floor(h * 0.45)::BIGINT END AS lo FROM d) SELECT x, z, y FROM l, LATERAL (SELECT unnest(range(lo, top + 1)) AS y) k""",
    ("voxel",),
)
def w17(t: Tables) -> DataFrame:
    """Canopies filled down, trunks under local maxima."""
    tops = t.voxel.filter("cls = 6").groupBy("x", "z").agg(F.max("y").alias("top"))
    ground = t.voxel.groupBy("x", "z").agg((F.min("y") % 3).alias("surf"))
    return out(points.canopy_fill(tops, ground), x="long", z="long", y="long")


# --- signals --------------------------------------------------------------------------------------------

_X = "x AS (SELECT l_orderkey AS track, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS i, l_discount * 10 - 0.45 AS v FROM lineitem)"


def _track(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.lineitem.select(c("l_orderkey").alias("track"), (F.row_number().over(w) - 1).alias("i"), (c("l_discount") * 10 - 0.45).alias("v"))


@query("a25_w14_levels", f"WITH {_X}, s AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY track ORDER BY i)) AS step FROM x) SELECT track, round(10 * log10(avg(v * v) + 1e-12), 6) AS rms_db, round(20 * log10(max(abs(v)) + 1e-12), 6) AS peak_db, round(abs(arg_max(v, i) - arg_min(v, i)), 9) AS seam, round(coalesce(avg(step), -1), 9) AS mean_step FROM s GROUP BY 1")
def a25(t: Tables) -> DataFrame:
    """RMS, peak, steps and the seam of a loop."""
    return out(signal.levels(_track(t), "track").na.fill(-1.0, ["mean_step"]), track="long", rms_db="round6", peak_db="round6", seam="round9", mean_step="round9")


@query("w13_levelled", f"WITH {_X}, l AS (SELECT *, 10 * log10(avg(v * v) OVER (PARTITION BY track ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + 1e-12) AS lv FROM x), m AS (SELECT track, median(lv) AS mid FROM l GROUP BY 1) SELECT track, i, round(v * pow(10, least(9, greatest(-9, mid - lv)) / 20), 6) AS v FROM l JOIN m USING (track)")
def w13(t: Tables) -> DataFrame:
    """A moving level evened out about its median, within 9 dB."""
    return out(signal.levelled(_track(t), "track", 1), track="long", i="long", v="round6")


@query("a27_credits", "WITH w AS (SELECT o_custkey % 40 AS k, o_orderpriority AS kind, o_custkey % 15 AS source, o_orderkey % 6 AS r, o_orderkey AS pos FROM orders), f AS (SELECT kind, source, r, min(k * 1000000 + pos) AS seen FROM w GROUP BY 1, 2, 3) SELECT kind, source, string_agg(r::VARCHAR, ',' ORDER BY seen) AS ranges FROM f GROUP BY 1, 2")
def a27(t: Tables) -> DataFrame:
    """Ranges by source in the order first seen, each once."""
    w = t.orders.select((c("o_custkey") % 40).alias("k"), c("o_orderpriority").alias("kind"), (c("o_custkey") % 15).alias("source"), (c("o_orderkey") % 6).alias("range"), c("o_orderkey").alias("pos"))
    d = signal.credits(w, "k")
    return out(d.select("kind", "source", F.concat_ws(",", F.transform("ranges", lambda r: r.cast("string"))).alias("ranges")), kind="string", source="long", ranges="string")


@query("g12_street_grid", "SELECT floor((x - 5) * cos(0.3) + (y - 7) * sin(0.3))::BIGINT AS u, floor(-((x - 5) * -sin(0.3) + (y - 7) * cos(0.3)))::BIGINT AS v, count(*) AS n FROM point GROUP BY 1, 2", ("point",))
def g12(t: Tables) -> DataFrame:
    """Points counted on a grid along the street."""
    from gridspan.functions.coords import rotated

    d = t.point.select(rotated(c("x"), c("y"), 5, 7, 0.3).alias("f")).groupBy(F.floor("f.u").alias("u"), F.floor("f.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return out(d, u="long", v="long", n="long")


@query("a18_feature_counts", "SELECT o_orderpriority AS kind, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS lod1, count(CASE WHEN o_orderkey % 3 = 1 THEN 1 END) AS lod2, count(CASE WHEN o_orderkey % 3 = 2 THEN 1 END) AS lod3 FROM orders GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    """Features by kind and level."""
    d = t.orders.select(c("o_orderpriority").alias("kind"), F.concat(F.lit("lod"), (c("o_orderkey") % 3 + 1).cast("string")).alias("lod"))
    p = d.groupBy("kind").pivot("lod", ["lod1", "lod2", "lod3"]).agg(F.count(F.lit(1))).na.fill(0)
    return out(p, kind="string", lod1="long", lod2="long", lod3="long")
