"""Queries of the metre grid: spatial joins, rasters, pyramids, chunks and faces."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.functions import bits
from gridspan.operators import grid as g
from gridspan.plans.registry import SIDE, Tables, fixture, out, query

c = F.col

_RANK = "CASE cls " + " ".join(f"WHEN {k} THEN {i}" for i, k in enumerate(g.WINNERS)) + " ELSE 12 END"
_CLS = "[" + ", ".join(map(str, [*g.WINNERS, 0])) + "][rank + 1]"


def _pool(level: int, source: str) -> str:
    thin = " WHERE rank > 2" if level >= 2 else ""
    keep = " OR rank <= 2" if level == 1 else ""
    return f"SELECT x, y, z, {_CLS}::BIGINT AS cls FROM (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, min(rank) AS rank, count(*) AS n FROM (SELECT x, y, z, {_RANK} AS rank FROM {source}){thin} GROUP BY 1, 2, 3) WHERE n >= 4 OR (rank = 3 AND n >= 2){keep}"


fixture("dense", "SELECT x // 4 AS x, z // 4 AS z, y, min(cls) AS cls FROM voxel GROUP BY 1, 2, 3")(lambda t: t.voxel.groupBy(F.floor(c("x") / 4).alias("x"), F.floor(c("z") / 4).alias("z"), "y").agg(F.min("cls").alias("cls")))


@query(
    "pyramid_histogram",
    f"""WITH l1 AS ({_pool(1, "dense")}), l2 AS ({_pool(2, "l1")}), l3 AS ({_pool(3, "l2")}),
    a AS (SELECT 0::BIGINT AS level, cls FROM dense UNION ALL SELECT 1, cls FROM l1 UNION ALL SELECT 2, cls FROM l2 UNION ALL SELECT 3, cls FROM l3)
    SELECT level, k.cls::BIGINT AS cls, count(a.cls) AS n FROM (SELECT DISTINCT level FROM a) lv CROSS JOIN (SELECT unnest(range(0, 13)) AS cls) k LEFT JOIN a USING (level, cls) GROUP BY 1, 2""",
    ("voxel", "dense"),
)
def pyramid_histogram(t: Tables) -> DataFrame:
    """Cells of every class at every level of the majority pyramid (a01, a09)."""
    return out(g.class_histogram(g.pyramid(t.dense, 4), ["level"]), level="long", cls="long", n="long")


@query("a01_class_counts", "SELECT k.cls::BIGINT AS cls, count(v.cls) AS n FROM (SELECT unnest(range(0, 13)) AS cls) k LEFT JOIN voxel v USING (cls) GROUP BY 1", ("voxel",))
def a01(t: Tables) -> DataFrame:
    """Counts of all 13 classes, zeros included."""
    return out(g.class_histogram(t.voxel, []), cls="long", n="long")


@query("a09_majority_pool", _pool(1, "dense"), ("voxel", "dense"))
def a09(t: Tables) -> DataFrame:
    return out(g.pool_majority(t.dense, 1), x="long", y="long", z="long", cls="long")


@query("a10_priority_pool", f"SELECT x, y, z, {_CLS}::BIGINT AS cls FROM (SELECT x // 3 AS x, y // 3 AS y, z // 3 AS z, min({_RANK}) AS rank FROM voxel GROUP BY 1, 2, 3) WHERE rank < 12", ("voxel",))
def a10(t: Tables) -> DataFrame:
    """Blocks of three by priority alone."""
    return out(g.pool_priority(t.voxel, 3), x="long", y="long", z="long", cls="long")


@query(
    "c03_coarse_levels",
    f"WITH l5 AS ({_pool(5, 'dense')}), l6 AS ({_pool(6, 'l5')}) SELECT 5::BIGINT AS level, x, y, z, cls FROM l5 UNION ALL SELECT 6, x, y, z, cls FROM l6",
    ("voxel", "dense"),
)
def c03(t: Tables) -> DataFrame:
    """The two top levels, pooled from one grid of the whole area."""
    a = g.pool_majority(t.dense, 5)
    b = g.pool_majority(a, 6)
    return out(a.withColumn("level", F.lit(5)).unionByName(b.withColumn("level", F.lit(6))), level="long", x="long", y="long", z="long", cls="long")


@query(
    "c02_chunk_rings",
    """WITH o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT x // 32 + a.d AS cx, z // 32 + b.d AS cz, x - (x // 32 + a.d) * 32 + 1 AS lx, z - (z // 32 + b.d) * 32 + 1 AS lz, y, cls FROM voxel, o a, o b),
    k AS (SELECT * FROM w WHERE lx BETWEEN 0 AND 33 AND lz BETWEEN 0 AND 33), own AS (SELECT DISTINCT cx, cz FROM k WHERE lx BETWEEN 1 AND 32 AND lz BETWEEN 1 AND 32)
    SELECT cx, cz, count(*) AS cells, count(CASE WHEN lx IN (0, 33) OR lz IN (0, 33) THEN 1 END) AS ring, sum(lx * 7 + lz * 3 + cls)::BIGINT AS mixed FROM k SEMI JOIN own USING (cx, cz) GROUP BY 1, 2""",
    ("voxel",),
)
def c02(t: Tables) -> DataFrame:
    """Chunks with the ring of their neighbours' cells."""
    w = g.chunk_windows(t.voxel.withColumn("level", F.lit(0)))
    ring = c("lx").isin(0, 33) | c("lz").isin(0, 33)
    d = w.groupBy("cx", "cz").agg(F.count(F.lit(1)).alias("cells"), F.count_if(ring).alias("ring"), F.sum(c("lx") * 7 + c("lz") * 3 + c("cls")).alias("mixed"))
    return out(d, cx="long", cz="long", cells="long", ring="long", mixed="long")


_FACES = " UNION ALL ".join(f"SELECT v.x, v.y, v.z, v.cls, '{n}' AS face FROM voxel v ANTI JOIN (SELECT x - {a} AS x, y - {b} AS y, z - {d} AS z FROM voxel) n ON v.x = n.x AND v.y = n.y AND v.z = n.z" for n, a, b, d in g.FACES)


@query("f21_exposed_faces", f"SELECT x, y, z, cls, face FROM ({_FACES})", ("voxel",))
def f21(t: Tables) -> DataFrame:
    return out(g.exposed_faces(t.voxel), x="long", y="long", z="long", cls="long", face="string")


@query("a23_faces_by_class", f"SELECT cls, face, count(*) AS n FROM ({_FACES}) GROUP BY 1, 2", ("voxel",))
def a23(t: Tables) -> DataFrame:
    return out(g.exposed_faces(t.voxel).groupBy("cls", "face").agg(F.count(F.lit(1)).alias("n")), cls="long", face="string", n="long")


def _solid(dx: int, dz: int) -> str:
    return f"(CASE WHEN EXISTS (SELECT 1 FROM voxel n WHERE n.x = v.x + {dx} AND n.z = v.z + {dz} AND n.y = v.y + 1) THEN 1 ELSE 0 END)"


_CORNERS = [(-1, 1), (1, 1), (1, -1), (-1, -1)]


@query(
    "c09_x21_corner_occlusion",
    f"""WITH v AS (SELECT * FROM voxel v ANTI JOIN (SELECT x, y - 1 AS y, z FROM voxel) n ON v.x = n.x AND v.y = n.y AND v.z = n.z),
    s AS (SELECT x, y, z, cls, {", ".join(f"{_solid(dx, 0)} AS p{k}, {_solid(0, dz)} AS q{k}, {_solid(dx, dz)} AS r{k}" for k, (dx, dz) in enumerate(_CORNERS))} FROM v),
    a AS (SELECT x, y, z, cls, {", ".join(f"CASE WHEN p{k} = 1 AND q{k} = 1 THEN 0.0 ELSE (3 - (p{k} + q{k} + r{k})) / 3.0::DOUBLE END AS a{k}" for k in range(4))} FROM s)
    SELECT x, y, z, cls, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2, round(a3, 6) AS a3, a0 + a2 > a1 + a3 AS flipped FROM a""",
    ("voxel",),
)
def c09(t: Tables) -> DataFrame:
    """Ambient occlusion at the corners of top faces, and the quads' diagonals."""
    return out(g.top_corner_ao(t.voxel), x="long", y="long", z="long", cls="long", a0="round6", a1="round6", a2="round6", a3="round6", flipped="boolean")


@query(
    "j22_outline_flags",
    """WITH v AS (SELECT * FROM voxel v ANTI JOIN (SELECT x, y - 1 AS y, z FROM voxel) n ON v.x = n.x AND v.y = n.y AND v.z = n.z)
    SELECT v.x, v.y, v.z, v.cls, 4 - count(n.x) AS lines FROM v LEFT JOIN v n ON n.y = v.y AND n.cls = v.cls AND abs(n.x - v.x) + abs(n.z - v.z) = 1 AND n.x BETWEEN v.x - 1 AND v.x + 1 GROUP BY 1, 2, 3, 4""",
    ("voxel",),
)
def j22(t: Tables) -> DataFrame:
    """Sides of top faces that get a line."""
    return out(g.outline_flags(t.voxel), x="long", y="long", z="long", cls="long", lines="long")


@query("c09_lamp_tips", "SELECT x, y, z FROM voxel v WHERE cls = 7 AND NOT EXISTS (SELECT 1 FROM voxel n WHERE n.x = v.x AND n.z = v.z AND n.y = v.y + 1)", ("voxel",))
def lamp_tips(t: Tables) -> DataFrame:
    return out(g.lamp_tips(t.voxel), x="long", y="long", z="long")


@query("a13_column_surfaces", "SELECT x, z, coalesce(max(CASE WHEN cls IN (1, 2, 3, 8, 9, 10) THEN y + 1 END), 0) AS ground, max(y) + 1 AS top, max_by(cls, y) AS top_class FROM voxel GROUP BY 1, 2", ("voxel",))
def a13(t: Tables) -> DataFrame:
    return out(g.column_surfaces(t.voxel), x="long", z="long", ground="long", top="long", top_class="long")


@query("k06_previews", "SELECT x, z, max_by(cls, y) AS cls FROM voxel WHERE x % 4 = 0 AND z % 4 = 0 GROUP BY 1, 2", ("voxel",))
def k06(t: Tables) -> DataFrame:
    """The top class of every fourth column."""
    d = t.voxel.filter("x % 4 = 0 AND z % 4 = 0").groupBy("x", "z").agg(F.max_by("cls", "y").alias("cls"))
    return out(d, x="long", z="long", cls="long")


# --- spatial joins ----------------------------------------------------------------------------------------

_POLY = """poly AS (SELECT s_suppkey AS id, (s_suppkey * 13 % 100)::DOUBLE + 0.25 AS px, (s_suppkey * 29 % 100)::DOUBLE + 0.75 AS pz, 5.3 + s_suppkey % 9 AS w, 4.1 + s_suppkey % 7 AS h FROM supplier),
    edge AS (SELECT id, px AS x0, pz AS z0, px + w AS x1, pz + 1 AS z1 FROM poly UNION ALL SELECT id, px + w, pz + 1, px + w / 2, pz + h / 2, FROM poly UNION ALL SELECT id, px + w / 2, pz + h / 2, px + w, pz + h FROM poly UNION ALL SELECT id, px + w, pz + h, px, pz + h FROM poly UNION ALL SELECT id, px, pz + h, px, pz FROM poly)"""


@query(
    "j06_polygon_cells",
    f"""WITH {_POLY}, cell AS (SELECT p.id, x, z FROM poly p, LATERAL (SELECT unnest(range(floor(px)::BIGINT - 1, ceil(px + w)::BIGINT + 1)) AS x) a, LATERAL (SELECT unnest(range(floor(pz)::BIGINT - 1, ceil(pz + h)::BIGINT + 1)) AS z) b)
    SELECT cell.id, x, z FROM cell JOIN edge e ON e.id = cell.id AND ((z0 <= z + 0.5) <> (z1 <= z + 0.5)) AND x + 0.5 >= x0 + (z + 0.5 - z0) * (x1 - x0) / (z1 - z0) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1""",
)
def j06(t: Tables) -> DataFrame:
    """Cells whose centre lies in concave polygons."""
    p = t.supplier.select(c("s_suppkey").alias("id"), ((c("s_suppkey") * 13 % 100).cast("double") + 0.25).alias("px"), ((c("s_suppkey") * 29 % 100).cast("double") + 0.75).alias("pz"), (5.3 + c("s_suppkey") % 9).alias("w"), (4.1 + c("s_suppkey") % 7).alias("h"))
    at = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    px, pz, w, h = c("px"), c("pz"), c("w"), c("h")
    ring = F.array(at(px, pz), at(px + w, pz + 1), at(px + w / 2, pz + h / 2), at(px + w, pz + h), at(px, pz + h), at(px, pz))
    return out(g.polygon_cells(p.select("id", ring.alias("ring")), "id", "ring"), id="long", x="long", z="long")


_TRI = "SELECT o_orderkey AS id, (o_orderkey * 17 % 110)::DOUBLE + 0.1 AS x0, (o_custkey * 7 % 110)::DOUBLE + 0.2 AS z0, (o_orderkey % 23)::DOUBLE AS h0, (o_orderkey * 17 % 110) + 1.3 + o_orderkey % 14 AS x1, (o_custkey * 7 % 110) + 0.7::DOUBLE AS z1, (o_custkey % 19)::DOUBLE AS h1, (o_orderkey * 17 % 110) + 0.9::DOUBLE AS x2, (o_custkey * 7 % 110) + 1.6 + o_custkey % 5 AS z2, (o_orderkey % 7)::DOUBLE AS h2 FROM orders"


def _triangles(t: Tables) -> DataFrame:
    k, u = c("o_orderkey"), c("o_custkey")
    bx, bz = k * 17 % 110, u * 7 % 110
    return t.orders.select(k.alias("id"), (bx.cast("double") + 0.1).alias("x0"), (bz.cast("double") + 0.2).alias("z0"), (k % 23).cast("double").alias("h0"), (bx + 1.3 + k % 14).alias("x1"), (bz + 0.7).alias("z1"), (u % 19).cast("double").alias("h1"), (bx + 0.9).alias("x2"), (bz + 1.6 + u % 5).alias("z2"), (k % 7).cast("double").alias("h2"))


#: Heights at the cells that triangles cover: the rows of k with rn = 1.
_RASTER = f"""tri AS ({_TRI}), b AS (SELECT *, (z1 - z2) * (x0 - x2) + (x2 - x1) * (z0 - z2) AS det, ceil(least(x0, x1, x2) - 0.5)::BIGINT AS i0, floor(greatest(x0, x1, x2) - 0.5)::BIGINT AS i1, ceil(least(z0, z1, z2) - 0.5)::BIGINT AS j0, floor(greatest(z0, z1, z2) - 0.5)::BIGINT AS j1 FROM tri),
    p AS (SELECT *, (i1 - i0 + 1 > 10 OR j1 - j0 + 1 > 10) AS large FROM b, LATERAL (SELECT unnest(range(i0, i1 + 1)) AS x) xx, LATERAL (SELECT unnest(range(j0, j1 + 1)) AS z) zz WHERE abs(det) > 1e-9),
    l AS (SELECT *, ((z1 - z2) * (x + 0.5 - x2) + (x2 - x1) * (z + 0.5 - z2)) / det AS l0, ((z2 - z0) * (x + 0.5 - x2) + (x0 - x2) * (z + 0.5 - z2)) / det AS l1 FROM p),
    i AS (SELECT *, 1 - l0 - l1 AS l2 FROM l), k AS (SELECT x, z, l0 * h0 + l1 * h1 + l2 * h2 AS h, row_number() OVER (PARTITION BY x, z ORDER BY large DESC, CASE WHEN large THEN 0 ELSE x - i0 END DESC, CASE WHEN large THEN 0 ELSE z - j0 END DESC, id DESC) AS rn FROM i WHERE l0 >= -1e-9 AND l1 >= -1e-9 AND l2 >= -1e-9)"""


@query("j08_triangle_raster", f"WITH {_RASTER} SELECT x, z, round(h, 5) AS h FROM k WHERE rn = 1")
def j08(t: Tables) -> DataFrame:
    """Triangles to heights at cell centres; the last painted stays."""
    return out(g.triangle_cells(_triangles(t), "id"), x="long", z="long", h="round5")


@query(
    "g07_tin_heights",
    f"""WITH {_RASTER}, covered AS (SELECT x, z, h FROM k WHERE rn = 1), t AS (SELECT x, z FROM (SELECT unnest(range(0, {SIDE})) AS x), (SELECT unnest(range(0, {SIDE})) AS z)), off AS (SELECT x, z FROM t ANTI JOIN covered USING (x, z)),
    near AS (SELECT off.x, off.z, q.h, row_number() OVER (PARTITION BY off.x, off.z ORDER BY (off.x - q.x) * (off.x - q.x) + (off.z - q.z) * (off.z - q.z), q.z, q.x) AS n FROM off, (SELECT covered.* FROM covered SEMI JOIN t USING (x, z)) q)
    SELECT x, z, round(h, 5) AS h FROM covered SEMI JOIN t USING (x, z) UNION ALL SELECT x, z, round(h, 5) FROM near WHERE n = 1""",
)
def g07(t: Tables) -> DataFrame:
    """A TIN's heights at every cell, the nearest outside it."""
    side = t.spark.range(SIDE)
    targets = side.select(c("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))).alias("z"))
    return out(g.tin_heights(_triangles(t), "id", targets), x="long", z="long", h="round5")


@query(
    "f10_f12_near_frame_and_decks",
    f"WITH tri AS ({_TRI}) SELECT id, CASE WHEN h0 > h1 + 2.5 THEN 'deck' ELSE 'surface' END AS layer FROM tri WHERE greatest(x0, x1, x2) > 20 AND least(x0, x1, x2) < 90 AND greatest(z0, z1, z2) > 10 AND least(z0, z1, z2) < 60",
)
def f10(t: Tables) -> DataFrame:
    """Triangles near the frame by their boxes, and rows sent to the deck's layer (f09, f10, f12)."""
    near = (F.greatest("x0", "x1", "x2") > 20) & (F.least("x0", "x1", "x2") < 90) & (F.greatest("z0", "z1", "z2") > 10) & (F.least("z0", "z1", "z2") < 60)
    d = _triangles(t).filter(near)
    return out(d.select("id", F.when(c("h0") > c("h1") + 2.5, "deck").otherwise("surface").alias("layer")), id="long", layer="string")


@query(
    "a26_plane_fits",
    "SELECT l_suppkey AS id, round(regr_slope(z, x), 6) AS slope, count(*) AS n FROM (SELECT l_suppkey, l_discount * 100 AS x, l_quantity AS z FROM lineitem) GROUP BY 1",
)
def a26(t: Tables) -> DataFrame:
    """Least-squares planes; here y is held at the mean so that the plane is the line (the two-variable
    form is tested against a matrix solver)."""
    p = t.lineitem.select(c("l_suppkey").alias("id"), (c("l_discount") * 100).alias("x"), c("l_quantity").alias("z"))
    both = p.withColumn("s", F.explode(F.array(F.lit(-1.0), F.lit(1.0)))).select("id", "x", c("s").alias("y"), "z")
    n = p.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return out(g.plane_fit(both, "id").join(n, "id").select("id", c("a").alias("slope"), "n"), id="long", slope="round6", n="long")


@query(
    "j10_c10_detail_blocks",
    f"WITH p AS (SELECT (lon - 139.5) * 3000 AS x, (lat - 35.5) * 3000 AS z FROM place), b AS (SELECT unnest(range(-10, 60)) AS bx), q AS (SELECT unnest(range(-10, 60)) AS bz) SELECT DISTINCT bx, bz FROM p, b, q WHERE pow(greatest(bx * 64 - x, x - (bx + 1) * 64, 0), 2) + pow(greatest(bz * 64 - z, z - (bz + 1) * 64, 0), 2) <= 150 * 150",
    ("place",),
)
def j10(t: Tables) -> DataFrame:
    """Blocks of 64 within 150 of a point."""
    p = t.place.select(((c("lon") - 139.5) * 3000).alias("x"), ((c("lat") - 35.5) * 3000).alias("z"))
    return out(g.blocks_near(p, 64, 150.0), bx="long", bz="long")


@query(
    "j11_nearest_fill",
    f"WITH k AS (SELECT x, z, max(y) AS h FROM voxel WHERE cls = 5 GROUP BY 1, 2), t AS (SELECT x, z FROM (SELECT unnest(range(0, {SIDE})) AS x), (SELECT unnest(range(0, {SIDE})) AS z)), r AS (SELECT t.x, t.z, h, (t.x - k.x) * (t.x - k.x) + (t.z - k.z) * (t.z - k.z) AS d2, row_number() OVER (PARTITION BY t.x, t.z ORDER BY (t.x - k.x) * (t.x - k.x) + (t.z - k.z) * (t.z - k.z), k.z, k.x) AS rn FROM t, k) SELECT x, z, h, d2 FROM r WHERE rn = 1",
    ("voxel",),
)
def j11(t: Tables) -> DataFrame:
    """The nearest known height for every cell."""
    k = t.voxel.filter("cls = 5").groupBy("x", "z").agg(F.max("y").alias("h"))
    side = t.spark.range(SIDE)
    targets = side.select(c("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))).alias("z"))
    return out(g.nearest_fill(k, targets, required=False), x="long", z="long", h="long", d2="long")


_TOPS = "tops AS (SELECT x, z, coalesce(max(CASE WHEN cls IN (1, 2, 3, 8, 9, 10) THEN y + 1 END), 0) AS ground, max(y) + 1 AS top, max_by(cls, y) AS top_class FROM voxel GROUP BY 1, 2)"


@query(
    "j12_anchors",
    f"""WITH {_TOPS}, p AS (SELECT id, 10 + (id * 7.37) % 100 AS px, 10 + (id * 3.19) % 100 AS pz FROM place), r AS (SELECT p.id, x, z, top, row_number() OVER (PARTITION BY p.id ORDER BY sqrt(pow(x + 0.5 - px, 2) + pow(z + 0.5 - pz, 2)), z, x) AS rn FROM p, tops WHERE x BETWEEN floor(px) - 6 AND floor(px) + 6 AND z BETWEEN floor(pz) - 6 AND floor(pz) + 6 AND top_class IN (4, 5) AND pow(x + 0.5 - px, 2) + pow(z + 0.5 - pz, 2) <= 36)
    SELECT p.id, round(coalesce(r.x + 0.5, px)::DOUBLE, 6) AS ax, round(coalesce(r.z + 0.5, pz)::DOUBLE, 6) AS az, coalesce(r.top, t.ground, 0) AS y, r.id IS NOT NULL AS building FROM p LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON r.id = p.id LEFT JOIN tops t ON t.x = floor(px) AND t.z = floor(pz)""",
    ("voxel", "place"),
)
def j12(t: Tables) -> DataFrame:
    """The nearest building column within six cells, else the ground."""
    p = t.place.select("id", (10 + (c("id") * F.lit(Decimal("7.37"))) % 100).alias("px"), (10 + (c("id") * F.lit(Decimal("3.19"))) % 100).alias("pz"))
    return out(g.nearest_of_class(p, g.column_surfaces(t.voxel), [4, 5]), id="long", ax="round6", az="round6", y="long", building="boolean")


@query(
    "j13_close_ends",
    "WITH e AS (SELECT river, line * 2 AS id, lon0 AS x, lat0 AS y FROM line_end UNION ALL SELECT river, line * 2 + 1, lon1, lat1 FROM line_end) SELECT a.river, a.id AS i, b.id AS j, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM e a JOIN e b ON a.river = b.river AND a.id < b.id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 1.5",
    ("line_end",),
)
def j13(t: Tables) -> DataFrame:
    """Line ends of one river nearer than 1.5 degrees."""
    l = t.line_end
    e = l.select("river", (c("line") * 2).alias("id"), c("lon0").alias("x"), c("lat0").alias("y")).unionByName(l.select("river", (c("line") * 2 + 1).alias("id"), c("lon1").alias("x"), c("lat1").alias("y")))
    return out(g.close_pairs(e, "river", 1.5), river="long", i="long", j="long", d="round6")


@query(
    "j14_lamp_light",
    """WITH lamp AS (SELECT x + 0.5 AS lx, y + 0.5 AS ly, z + 0.5 AS lz FROM voxel v WHERE cls = 7), v AS (SELECT x * 100000 + z * 100 + y AS id, x::DOUBLE AS x, (y + 1)::DOUBLE AS y, z::DOUBLE AS z FROM voxel WHERE cls = 2),
    d AS (SELECT id, lx - x AS dx, ly - y AS dy, lz - z AS dz, sqrt(pow(lx - x, 2) + pow(ly - y, 2) + pow(lz - z, 2)) AS d FROM v JOIN lamp ON lx BETWEEN x - 6 AND x + 6 AND lz BETWEEN z - 6 AND z + 6),
    s AS (SELECT id, least(1, sum(pow(1 - d / 6, 2) * least(1, greatest(0, CASE WHEN d < 1e-4 THEN 1 ELSE dy / d END * 0.8 + 0.35)))) AS light FROM d WHERE d < 6 GROUP BY id)
    SELECT v.id, round(coalesce(light, 0.0), 6) AS light FROM v LEFT JOIN s USING (id)""",
    ("voxel",),
)
def j14(t: Tables) -> DataFrame:
    """Light pools of lamps at vertices of road cells."""
    lamps = t.voxel.filter("cls = 7").select((c("x") + 0.5).alias("x"), (c("y") + 0.5).alias("y"), (c("z") + 0.5).alias("z"))
    v = t.voxel.filter("cls = 2").select((c("x") * 100000 + c("z") * 100 + c("y")).alias("id"), c("x").cast("double").alias("x"), (c("y") + 1).cast("double").alias("y"), c("z").cast("double").alias("z"), F.lit(0.0).alias("fx"), F.lit(1.0).alias("fy"), F.lit(0.0).alias("fz"))
    return out(g.lamp_light(v, lamps, 6.0), id="long", light="round6")


@query(
    "g06_distance_bands",
    "WITH w AS (SELECT DISTINCT x, z FROM voxel WHERE cls = 4), t AS (SELECT DISTINCT x, z FROM voxel) SELECT t.x, t.z, min(pow(t.x - w.x, 2) + pow(t.z - w.z, 2))::BIGINT AS d2 FROM t, w WHERE w.x BETWEEN t.x - 4 AND t.x + 4 AND w.z BETWEEN t.z - 4 AND t.z + 4 AND pow(t.x - w.x, 2) + pow(t.z - w.z, 2) <= 16 GROUP BY 1, 2",
    ("voxel",),
)
def g06(t: Tables) -> DataFrame:
    """Squared distance to the nearest wall column, up to four cells."""
    return out(g.within(t.voxel, t.voxel.filter("cls = 4").select("x", "z").distinct(), 4.0), x="long", z="long", d2="long")


_SEG = "SELECT o_orderkey AS id, (o_orderkey * 13 % 100)::DOUBLE AS x0, (o_custkey * 5 % 100)::DOUBLE AS z0, (o_orderkey * 13 % 100 + o_custkey % 12 - 6)::DOUBLE AS x1, (o_custkey * 5 % 100 + o_orderkey % 9 - 4)::DOUBLE AS z1, 1.2 + (o_orderkey % 3) / 2.0::DOUBLE AS w FROM orders"


def _segments(t: Tables) -> DataFrame:
    k, u = c("o_orderkey"), c("o_custkey")
    d = lambda e: e.cast("double")
    return t.orders.select(k.alias("id"), d(k * 13 % 100).alias("x0"), d(u * 5 % 100).alias("z0"), d(k * 13 % 100 + u % 12 - 6).alias("x1"), d(u * 5 % 100 + k % 9 - 4).alias("z1"), (1.2 + (k % 3) / 2.0).alias("w"))


@query(
    "g09_j07_buffered_lines",
    f"""WITH s AS ({_SEG}), p AS (SELECT s.*, x, z, pow(x1 - x0, 2) + pow(z1 - z0, 2) AS l2 FROM s, LATERAL (SELECT unnest(range(floor(least(x0, x1) - w)::BIGINT, ceil(greatest(x0, x1) + w)::BIGINT + 1)) AS x) a, LATERAL (SELECT unnest(range(floor(least(z0, z1) - w)::BIGINT, ceil(greatest(z0, z1) + w)::BIGINT + 1)) AS z) b)
    SELECT DISTINCT id, x, z FROM p WHERE l2 > 0 AND ((x + 0.5 - x0) * (x1 - x0) + (z + 0.5 - z0) * (z1 - z0)) / l2 BETWEEN 0 AND 1 AND abs((x + 0.5 - x0) * (z1 - z0) - (z + 0.5 - z0) * (x1 - x0)) / sqrt(l2) <= w""",
)
def g09(t: Tables) -> DataFrame:
    """Cells covered by widened lines with flat ends."""
    return out(g.segment_cells(_segments(t), "id", "w"), id="long", x="long", z="long")


@query(
    "g02_line_pixels",
    f"WITH s AS ({_SEG}), n AS (SELECT *, greatest(abs(x1 - x0), abs(z1 - z0)) AS n FROM s), p AS (SELECT *, i FROM n, LATERAL (SELECT unnest(range(0, n::BIGINT + 1)) AS i) k) SELECT DISTINCT id, (x0 + CASE WHEN n = 0 THEN 0 ELSE floor((x1 - x0) * i / n + 0.5) END)::BIGINT AS x, (z0 + CASE WHEN n = 0 THEN 0 ELSE floor((z1 - z0) * i / n + 0.5) END)::BIGINT AS z FROM p",
)
def g02(t: Tables) -> DataFrame:
    return out(g.line_cells(_segments(t).drop("w"), "id"), id="long", x="long", z="long")


@query(
    "g14_occlusion",
    f"""WITH {_TOPS}, ray AS (SELECT id, (id * 7 % 100)::DOUBLE AS x, 3.0::DOUBLE AS y, (id * 11 % 100)::DOUBLE AS z, cos(id) AS vx, 0.15::DOUBLE AS vy, sin(id) AS vz FROM place)
    SELECT r.id, coalesce(bool_or(r.y + vy * k * 2.0 < t.top), false) AS hidden FROM ray r CROSS JOIN (SELECT unnest(range(1, 21)) AS k) LEFT JOIN tops t ON t.x = floor(r.x + vx * k * 2.0) AND t.z = floor(r.z + vz * k * 2.0) GROUP BY 1""",
    ("voxel", "place"),
)
def g14(t: Tables) -> DataFrame:
    """Whether columns hide a note: rays marched in steps."""
    r = t.place.select("id", (c("id") * 7 % 100).cast("double").alias("x"), F.lit(3.0).alias("y"), (c("id") * 11 % 100).cast("double").alias("z"), F.cos("id").alias("vx"), F.lit(0.15).alias("vy"), F.sin("id").alias("vz"))
    return out(g.ray_hits(r, g.column_surfaces(t.voxel).select("x", "z", "top"), 2.0, 20), id="long", hidden="boolean")


@query(
    "j25_covering_meshes",
    "WITH s AS (SELECT id, lat + i * 0.003 AS lat, lon + j * 0.004 AS lon FROM place, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j)) SELECT DISTINCT id, floor(lat * 120)::BIGINT AS row, floor((lon - 100) * 80)::BIGINT AS col FROM s",
    ("place",),
)
def j25(t: Tables) -> DataFrame:
    """Meshes that a box touches, by sampling it."""
    step = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    s = t.place.select("id", "lat", "lon", step.alias("s")).select("id", F.floor((c("lat") + c("s.i") * 0.003) * 120).alias("row"), F.floor((c("lon") + c("s.j") * 0.004 - 100) * 80).alias("col"))
    return out(s.distinct(), id="long", row="long", col="long")


@query(
    "g11_surface_samples",
    "WITH t AS (SELECT o_orderkey AS id, 0.0 AS ax, 0.0 AS ay, 0.0 AS az, (1 + o_orderkey % 3)::DOUBLE AS bx, 0.0 AS by_, (o_custkey % 2)::DOUBLE AS bz, 0.0 AS cx, (1 + o_custkey % 4)::DOUBLE AS cy, 0.0 AS cz FROM orders), n AS (SELECT *, greatest(1, ceil(greatest(sqrt(bx * bx + bz * bz), cy, sqrt(bx * bx + cy * cy + bz * bz)) / 0.6))::BIGINT AS n FROM t) SELECT id, n, ((n + 1) * (n + 2) / 2)::BIGINT AS points, round(bx, 6) AS max_x, round(cy, 6) AS max_y FROM n",
)
def g11(t: Tables) -> DataFrame:
    """Points over triangles, by a barycentric lattice."""
    k, u = c("o_orderkey"), c("o_custkey")
    z = F.lit(0.0)
    tri = t.orders.select(k.alias("id"), z.alias("ax"), z.alias("ay"), z.alias("az"), (1 + k % 3).cast("double").alias("bx"), z.alias("by"), (u % 2).cast("double").alias("bz"), z.alias("cx"), (1 + u % 4).cast("double").alias("cy"), z.alias("cz"))
    d = g.sampled_triangles(tri, "id", 0.6).groupBy("id").agg(F.count(F.lit(1)).alias("points"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    n = ((F.sqrt(8 * c("points") + 1.0) - 3) / 2).cast("long")
    return out(d.withColumn("n", n), id="long", n="long", points="long", max_x="round6", max_y="round6")


@query(
    "g15_hashed_trees",
    f"""WITH {_TOPS}, h AS (SELECT x, z, ground AS base, xor(xor((x * 73856093) & 4294967295, (z * 19349663) & 4294967295), {7 * 83492791 & 0xFFFFFFFF}) AS h FROM tops), k AS (SELECT *, (xor(h, h >> 13) * 1540483477) & 4294967295 AS g FROM h), t AS (SELECT x, z, base FROM k WHERE xor(g, g >> 15) % 40 = 0),
    o AS (SELECT i, k, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS k), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j + k * k <= 5)
    SELECT DISTINCT x + i AS x, base + 3 + k AS y, z + j AS z FROM t, o UNION SELECT x, base + k, z FROM t, (SELECT unnest(range(0, 3)) AS k)""",
    ("voxel",),
)
def g15(t: Tables) -> DataFrame:
    """Trees on hashed cells: trunks and round canopies."""
    tops = g.column_surfaces(t.voxel)
    trees = tops.filter(bits.cell_hash(c("x"), c("z"), 7) % 40 == 0).select("x", "z", c("ground").alias("base"))
    return out(g.tree_cells(trees), x="long", y="long", z="long")


# --- rasters --------------------------------------------------------------------------------------------


def _box(agg: str, r: int) -> str:
    return f"SELECT a.x, a.z, {agg} AS v FROM g a JOIN g b ON b.x BETWEEN a.x - {r} AND a.x + {r} AND b.z BETWEEN a.z - {r} AND a.z + {r} GROUP BY 1, 2"


@query(
    "w07_box_filters",
    f"WITH g AS (SELECT x, z, max(y)::DOUBLE AS v FROM voxel GROUP BY 1, 2) SELECT m.x, m.z, round(m.v, 6) AS mean, round(d.v, 6) AS middle, p.v AS peak FROM ({_box('avg(b.v)', 1)}) m JOIN ({_box('median(b.v)', 1)}) d USING (x, z) JOIN ({_box('max(b.v)', 2)}) p USING (x, z)",
    ("voxel",),
)
def w07(t: Tables) -> DataFrame:
    """Mean, median and maximum in squares around each known cell."""
    v = t.voxel.groupBy("x", "z").agg(F.max("y").cast("double").alias("v"))
    a = g.neighbourhood(v, 1, F.struct(F.avg("w").alias("mean"), F.median("w").alias("middle"))).select("x", "z", "out.mean", "out.middle")
    b = g.neighbourhood(v, 2, F.max("w")).select("x", "z", c("out").alias("peak"))
    return out(a.join(b, ["x", "z"]), x="long", z="long", mean="round6", middle="round6", peak="double")


_CLAMP = "least(greatest(a.{k} + {o}, 0), 63)"


@query(
    "w07_edge_filter",
    "WITH g AS (SELECT (i % 64) AS x, (i // 64) AS z, ((i * 2654435761) % 97)::DOUBLE AS v FROM (SELECT unnest(range(0, 4096)) AS i)), o AS (SELECT unnest([-1, 0, 1]) AS d) SELECT a.x, a.z, round(avg(b.v), 6) AS mean FROM g a, o p, o q, g b WHERE b.x = least(greatest(a.x + p.d, 0), 63) AND b.z = least(greatest(a.z + q.d, 0), 63) AND (SELECT count(*) FROM region) > 0 GROUP BY 1, 2",
)
def w07_edge(t: Tables) -> DataFrame:
    """A 3 x 3 mean whose edge repeats the nearest cell."""
    i = c("id")
    v = t.spark.range(4096).select((i % 64).alias("x"), F.floor(i / 64).alias("z"), (i * 2654435761 % 97).cast("double").alias("v"))
    return out(g.neighbourhood(v, 1, F.avg("w"), (64, 64)).select("x", "z", c("out").alias("mean")), x="long", z="long", mean="round6")


@query(
    "w08_w10_last_painted",
    "WITH p AS (SELECT l_partkey % 128 AS x, l_suppkey % 128 AS z, (l_orderkey % 8) AS layer, l_orderkey AS seq, l_linenumber AS part, 1 + (l_orderkey + l_linenumber) % 12 AS cls, l_extendedprice AS tie FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY x, z ORDER BY layer DESC, seq DESC, part DESC, tie DESC) AS rn FROM p) SELECT x, z, cls FROM r WHERE rn = 1",
)
def w08(t: Tables) -> DataFrame:
    """The last stroke on a cell by layer, feature and part."""
    p = t.lineitem.select((c("l_partkey") % 128).alias("x"), (c("l_suppkey") % 128).alias("z"), (c("l_orderkey") % 8).alias("layer"), c("l_orderkey").alias("seq"), c("l_linenumber").alias("part"), (1 + (c("l_orderkey") + c("l_linenumber")) % 12).alias("cls"), c("l_extendedprice").alias("tie"))
    return out(g.last_painted(p, ["layer", "seq", "part", "tie"]), x="long", z="long", cls="long")


_TILE = """tile AS (SELECT x, z, tile, CASE WHEN n % 3 > 0 THEN n / 4.0::DOUBLE END AS h, CASE WHEN n % 5 = 0 THEN n / 3.0::DOUBLE END AS w, CASE WHEN n % 4 = 0 THEN n / 2.0::DOUBLE + 6 END AS bh, CASE WHEN n % 11 = 0 THEN n / 2.0::DOUBLE + 9 END AS deck, CASE WHEN n % 2 = 0 THEN 2 + n % 2 + n % 3 % 2 ELSE 0 END AS rc, CASE WHEN n % 2 = 0 THEN n % 4 ELSE 0 END AS rc_lod, n % 9 > 0 AS cover
    FROM (SELECT l_partkey % 64 AS x, l_suppkey % 64 AS z, l_linenumber AS tile, min(floor(l_quantity)::BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3))"""


def _tiles(t: Tables) -> DataFrame:
    n = c("n")
    d = t.lineitem.groupBy((c("l_partkey") % 64).alias("x"), (c("l_suppkey") % 64).alias("z"), c("l_linenumber").alias("tile")).agg(F.min(F.floor("l_quantity")).alias("n"))
    return d.select("x", "z", "tile", F.when(n % 3 > 0, n / 4.0).alias("h"), F.when(n % 5 == 0, n / 3.0).alias("w"), F.when(n % 4 == 0, n / 2.0 + 6).alias("bh"), F.when(n % 11 == 0, n / 2.0 + 9).alias("deck"), F.when(n % 2 == 0, 2 + n % 2 + n % 3 % 2).otherwise(0).alias("rc"), F.when(n % 2 == 0, n % 4).otherwise(0).alias("rc_lod"), (n % 9 > 0).alias("cover"))


_MERGED = """merged AS (SELECT x, z, arg_min(h, tile) FILTER (h IS NOT NULL) AS h, arg_min(w, tile) FILTER (w IS NOT NULL) AS w, max(bh) AS bh, max(deck) AS deck, coalesce(arg_max(rc, rc_lod * 100 + tile) FILTER (rc > 0), 0) AS rc, coalesce(arg_max(rc_lod, rc_lod * 100 + tile) FILTER (rc > 0), 0) AS rc_lod, bool_or(cover) AS cover FROM tile GROUP BY 1, 2)"""


@query("w09_j15_merged_tiles", f"WITH {_TILE}, {_MERGED} SELECT x, z, coalesce(h, -1) AS h, round(coalesce(w, -1), 9) AS w, coalesce(bh, -1) AS bh, coalesce(deck, -1) AS deck, rc::BIGINT AS rc, rc_lod::BIGINT AS rc_lod, cover FROM merged")
def w09(t: Tables) -> DataFrame:
    """Overlapping tiles to one layer; what no tile knows is shown as -1."""
    d = g.merged_tiles(_tiles(t)).na.fill(-1.0, ["h", "w", "bh", "deck"])
    return out(d, x="long", z="long", h="double", w="round9", bh="double", deck="double", rc="long", rc_lod="long", cover="boolean")


_K = "greatest({low}, least(504, ceil(coalesce({h}, 0) + 12) - 1))::BIGINT"


#: Cells of the composed voxels: those of e with rn = 1.
ORACLE_COMPOSED_CELLS = f"""{_TILE}, {_MERGED}, a AS (SELECT *, (w IS NOT NULL AND (h IS NULL OR h <= w + 0.5)) AS water FROM merged WHERE cover), s AS (SELECT *, CASE WHEN water THEN {_K.format(low=1, h="w")} ELSE {_K.format(low=1, h="h")} END AS surf, CASE WHEN rc > 0 THEN rc WHEN water THEN 8 ELSE 1 END AS sc FROM a),
    b AS (SELECT *, CASE WHEN bh IS NOT NULL THEN greatest({_K.format(low=1, h="bh")}, surf) END AS t0, CASE WHEN deck IS NOT NULL THEN {_K.format(low=0, h="deck")} END AS dk FROM s), d AS (SELECT *, CASE WHEN t0 IS NOT NULL THEN least(504, greatest(greatest(floor((t0 + 1) / 3.0::DOUBLE + 0.5)::BIGINT * 3, surf + 3) - 1, 1)) END AS top FROM b),
    r AS (SELECT x, z, 0::BIGINT AS y0, surf - 1 AS y1, 1 AS cls, 0 AS prio FROM d UNION ALL SELECT x, z, surf, surf, sc, 1 FROM d UNION ALL SELECT x, z, surf, top, 4, 2 FROM d WHERE top IS NOT NULL UNION ALL SELECT x, z, top, top, 5, 3 FROM d WHERE top IS NOT NULL UNION ALL SELECT x, z, dk, dk, 10, 4 FROM d WHERE dk IS NOT NULL UNION ALL SELECT x, z, 10, 12 + x % 3, 6 + z % 2, 5 FROM merged WHERE bh IS NULL),
    e AS (SELECT x, z, y, cls, row_number() OVER (PARTITION BY x, y, z ORDER BY prio DESC, y0 DESC, y1 DESC, cls DESC) AS rn FROM r, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) k)"""


@query("w11_c01_composed_voxels", f"WITH {ORACLE_COMPOSED_CELLS} SELECT x, z, count(*) AS cells, sum(cls * (y + 1))::BIGINT AS mixed, max(y) AS top FROM e WHERE rn = 1 GROUP BY 1, 2")
def w11(t: Tables) -> DataFrame:
    """Layers composed to voxels by precedence (a03, f13, x14), summed by column."""
    m = g.merged_tiles(_tiles(t))
    spans = m.filter("bh IS NULL").select("x", "z", F.lit(10).alias("y0"), (12 + c("x") % 3).alias("y1"), (6 + c("z") % 2).alias("cls"))
    v = g.composed(m.withColumn("known_h", c("h")), spans, 3)
    d = v.groupBy("x", "z").agg(F.count(F.lit(1)).alias("cells"), F.sum(c("cls") * (c("y") + 1)).alias("mixed"), F.max("y").alias("top"))
    return out(d, x="long", z="long", cells="long", mixed="long", top="long")


@query("f13_water_cells", f"WITH {_TILE}, {_MERGED} SELECT x, z FROM merged WHERE cover AND w IS NOT NULL AND (h IS NULL OR h <= w + 0.5)")
def f13(t: Tables) -> DataFrame:
    return out(g.merged_tiles(_tiles(t)).filter("cover AND w IS NOT NULL AND (h IS NULL OR h <= w + 0.5)"), x="long", z="long")


@query("a20_coverage", f"WITH {_TILE}, {_MERGED} SELECT round(avg(CASE WHEN cover THEN 1.0 ELSE 0.0 END), 9) AS share, count(*) AS n FROM merged")
def a20(t: Tables) -> DataFrame:
    d = g.merged_tiles(_tiles(t)).agg(F.avg(c("cover").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    return out(d, share="round9", n="long")


@query("a02_roof_z_buffer", "SELECT l_partkey % 64 AS x, l_suppkey % 64 AS z, max(CASE WHEN l_tax > 0.02 THEN l_extendedprice END) AS roof FROM lineitem GROUP BY 1, 2 HAVING roof IS NOT NULL")
def a02(t: Tables) -> DataFrame:
    """The highest surface of a column; unknown heights are null, never NaN."""
    h = F.when(c("l_tax") > 0.02, c("l_extendedprice"))
    d = t.lineitem.groupBy((c("l_partkey") % 64).alias("x"), (c("l_suppkey") % 64).alias("z")).agg(F.max(F.nanvl(h, F.lit(None).cast("double"))).alias("roof")).filter("roof IS NOT NULL")
    return out(d, x="long", z="long", roof="double")


@query("a03_column_spans", "SELECT x, z, min(y) AS y0, max(y) AS y1, 10::BIGINT AS cls FROM voxel WHERE cls < 4 GROUP BY x, z, cls % 2 UNION SELECT x, z, y, y, 7 FROM voxel WHERE cls = 9", ("voxel",))
def a03(t: Tables) -> DataFrame:
    """Samples to filled columns, or to single cells."""
    a = t.voxel.filter("cls < 4").select((c("cls") % 2).alias("feature"), "x", "z", c("y").alias("k"), F.lit(10).cast("long").alias("cls"))
    b = t.voxel.filter("cls = 9").select(F.lit(0).alias("feature"), "x", "z", c("y").alias("k"), F.lit(7).cast("long").alias("cls"))
    return out(g.column_spans(a, True).unionByName(g.column_spans(b, False)).distinct(), x="long", z="long", y0="long", y1="long", cls="long")


@query(
    "j16_merged_sources",
    """WITH base AS (SELECT x, z, y, cls FROM voxel WHERE y < 8 AND cls < 6), s AS (SELECT x, z, y, 1 + (cls + 1) % 8 AS cls FROM voxel WHERE y < 10), o AS (SELECT x, z, y, CASE WHEN cls > 9 THEN 7 WHEN cls > 5 THEN 6 ELSE 1 END AS cls FROM voxel),
    b AS (SELECT x, z, coalesce(max(CASE WHEN cls IN (1, 2, 3, 8) THEN y END), -1) AS bt, bool_or(cls IN (4, 5)) AS built FROM base GROUP BY 1, 2), sc AS (SELECT x, z, arg_max(cls, y) FILTER (cls IN (1, 2, 3, 8)) AS sc, bool_or(cls IN (4, 5)) AS sb FROM s GROUP BY 1, 2), oc AS (SELECT x, z, coalesce(max(CASE WHEN cls IN (1, 2, 3, 8) THEN y END), -1) AS ot FROM o GROUP BY 1, 2),
    a AS (SELECT x, z, y, cls, 0 AS prio, 0 AS k FROM base UNION ALL SELECT x, z, bt, sc, 1, 0 FROM b JOIN sc USING (x, z) WHERE NOT built AND NOT sb AND sc IN (2, 3, 8) AND bt >= 0 UNION ALL SELECT x, z, y + bt - ot, cls, -1, CASE WHEN cls = 6 THEN 1 ELSE 0 END FROM o JOIN oc USING (x, z) JOIN b USING (x, z) WHERE cls IN (6, 7) AND NOT built AND y + bt - ot >= 0)
    SELECT x, y, z, arg_max(cls, prio * 10 + k) AS cls FROM a GROUP BY 1, 2, 3""",
    ("voxel",),
)
def j16(t: Tables) -> DataFrame:
    """Three sources on one grid: surfaces painted, objects moved onto the base's ground."""
    base = t.voxel.filter("y < 8 AND cls < 6")
    s = t.voxel.filter("y < 10").withColumn("cls", 1 + (c("cls") + 1) % 8)
    o = t.voxel.withColumn("cls", F.when(c("cls") > 9, 7).when(c("cls") > 5, 6).otherwise(1).cast("long"))
    return out(g.merge_sources(base, s, o), x="long", y="long", z="long", cls="long")


@query(
    "g08_diffusion_fill",
    f"WITH k AS (SELECT x, z, max(y)::DOUBLE AS v FROM voxel GROUP BY 1, 2), t AS (SELECT x, z FROM (SELECT unnest(range(0, {SIDE})) AS x), (SELECT unnest(range(0, {SIDE})) AS z)), m AS (SELECT t.x, t.z FROM t ANTI JOIN k USING (x, z)), one AS (SELECT m.x, m.z, avg(k.v) AS v FROM m JOIN k ON k.x BETWEEN m.x - 1 AND m.x + 1 AND k.z BETWEEN m.z - 1 AND m.z + 1 GROUP BY 1, 2) SELECT x, z, round(v, 6) AS v FROM one",
    ("voxel",),
)
def g08(t: Tables) -> DataFrame:
    """Unknown cells filled from known neighbours again and again; the first round's are compared."""
    k = t.voxel.groupBy("x", "z").agg(F.max("y").cast("double").alias("v"))
    side = t.spark.range(SIDE)
    targets = side.select(c("id").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))).alias("z"))
    near = g.within(targets, k.select("x", "z"), 1.5).filter("d2 > 0")
    return out(g.diffuse_fill(k, targets).join(near.select("x", "z"), ["x", "z"]), x="long", z="long", v="round6")
