"""Queries of the scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.functions import bits, coords, curves, text
from gridspan.plans.registry import Tables, out, query

c = F.col


@query(
    "x06_value_symbols",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, d, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS zz, d AS back,
    CASE WHEN v < 12 THEN v ELSE 12 + (length(bin(v)) - 1 - 3) END AS sym, CASE WHEN v < 12 THEN 0 ELSE length(bin(v)) - 1 END::BIGINT AS nbits, CASE WHEN v < 12 THEN 0 ELSE v - (1::BIGINT << (length(bin(v)) - 1)::INT) END AS mantissa
    FROM (SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey * 9 AS d, l_partkey * l_suppkey % 5000 AS v FROM lineitem)""",
)
def x06(t: Tables) -> DataFrame:
    """Zigzag both ways and value symbols."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", (c("l_partkey") - c("l_suppkey") * 9).alias("d"), (c("l_partkey") * c("l_suppkey") % 5000).alias("v"))
    s = bits.value_symbol(c("v"))
    return out(d.select("l_orderkey", "l_linenumber", "d", bits.zigzag(c("d")).alias("zz"), bits.unzigzag(bits.zigzag(c("d"))).alias("back"), s["sym"].alias("sym"), s["bits"].alias("nbits"), s["mantissa"].alias("mantissa")), l_orderkey="long", l_linenumber="long", d="long", zz="long", back="long", sym="long", nbits="long", mantissa="long")


_SPREAD = " | ".join(f"(((({{v}}) >> {b}) & 1) << {2 * b})" for b in range(14))


@query(
    "x07_morton_and_chunk_keys",
    f"""SELECT o_orderkey, x, z, level, ({_SPREAD.format(v="x")}) | (({_SPREAD.format(v="z")}) << 1) AS morton, level * 67108864 + z * 33554432 // 1 * 1 // 4096 AS key_value, level + 1 AS up_level, x >> 1 AS up_x, z >> 1 AS up_z
    FROM (SELECT o_orderkey, o_orderkey % 8192 AS x, o_custkey % 8192 AS z, o_orderkey % 6 AS level FROM orders)""".replace("z * 33554432 // 1 * 1 // 4096", "z * 8192 + x"),
)
def x07(t: Tables) -> DataFrame:
    """Interleaved keys, packed chunk keys, and the parent's parts."""
    d = t.orders.select("o_orderkey", (c("o_orderkey") % 8192).alias("x"), (c("o_custkey") % 8192).alias("z"), (c("o_orderkey") % 6).alias("level"))
    k = bits.chunk_key(c("level"), c("x"), c("z"))
    d = d.withColumn("key_value", k).withColumn("up", bits.parent_key(c("key_value")))
    return out(d.select("o_orderkey", "x", "z", "level", bits.morton(c("x"), c("z")).alias("morton"), "key_value", bits.key_level(c("up")).alias("up_level"), bits.key_x(c("up")).alias("up_x"), bits.key_z(c("up")).alias("up_z")), o_orderkey="long", x="long", z="long", level="long", morton="long", key_value="long", up_level="long", up_x="long", up_z="long")


M = "4294967295"


@query(
    "x08_cell_hashes",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey - 500 AS ix, l_suppkey - 20 AS iz FROM lineitem),
    h1 AS (SELECT *, xor(xor(((ix & {M}) * 73856093) & {M}, ((iz & {M}) * 19349663) & {M}), {7 * 83492791 & 0xFFFFFFFF}) AS h, xor(xor(((ix & {M}) * 374761393) & {M}, ((iz & {M}) * 668265263) & {M}), {3 * 1442695041 & 0xFFFFFFFF}) AS g FROM a),
    h2 AS (SELECT *, ((xor(h, h >> 13)) * 1540483477) & {M} AS h3, (xor(g, g >> 13) * 1274126177) & {M} AS g3 FROM h1)
    SELECT l_orderkey, l_linenumber, xor(h3, h3 >> 15) AS cell, xor(g3, g3 >> 16) / 4294967296.0::DOUBLE AS lattice, xor(h3, h3 >> 15) % 40 = 0 AS chosen FROM h2""",
)
def x08(t: Tables) -> DataFrame:
    """The two lattice hashes, at negative coordinates too, and a hashed choice of one in 40."""
    d = t.lineitem.select("l_orderkey", "l_linenumber", (c("l_partkey") - 500).alias("ix"), (c("l_suppkey") - 20).alias("iz"))
    h = bits.cell_hash(c("ix"), c("iz"), 7)
    return out(d.select("l_orderkey", "l_linenumber", h.alias("cell"), bits.lattice_hash(c("ix"), c("iz"), 3).alias("lattice"), (h % 40 == 0).alias("chosen")), l_orderkey="long", l_linenumber="long", cell="long", lattice="double", chosen="boolean")


@query(
    "x09_mesh_codes",
    """WITH k AS (SELECT id, lat, lon, floor(lat * 120)::BIGINT AS a, floor((lon - 100) * 80)::BIGINT AS o FROM place),
    d AS (SELECT *, a // 80 AS p, o // 80 AS u, (a % 80) // 10 AS q, (o % 80) // 10 AS v, a % 10 AS s, o % 10 AS w FROM k),
    m AS (SELECT id, lpad(p::VARCHAR, 2, '0') || lpad(u::VARCHAR, 2, '0') || q || v || s || w AS code, (p * 40 + q * 5) / 60.0::DOUBLE + s * 0.5 / 60 AS lat0, 100 + u + v * 7.5 / 60 + w * 0.75 / 60 AS lon0, lat, lon FROM d)
    SELECT id, code, round(lat0, 9) AS lat0, round(lon0::DOUBLE, 9) AS lon0, round(lat0 + 0.5 / 60, 9) AS lat1, round((lon0 + 0.75 / 60)::DOUBLE, 9) AS lon1, lat0 <= lat + 1e-9 AND lat < lat0 + 0.5 / 60 + 1e-9 AND lon0 <= lon + 1e-9 AND lon < lon0 + 0.75 / 60 + 1e-9 AS inside FROM m""",
    ("place",),
)
def x09(t: Tables) -> DataFrame:
    """The mesh of each place, and its bounds from the code."""
    d = t.place.select("id", "lat", "lon", coords.mesh_code(c("lat"), c("lon")).alias("code")).withColumn("b", coords.mesh_bounds(c("code")))
    inside = (c("b.lat0") <= c("lat") + 1e-9) & (c("lat") < c("b.lat1") + 1e-9) & (c("b.lon0") <= c("lon") + 1e-9) & (c("lon") < c("b.lon1") + 1e-9)
    return out(d.select("id", "code", "b.lat0", "b.lon0", "b.lat1", "b.lon1", inside.alias("inside")), id="long", code="string", lat0="round9", lon0="round9", lat1="round9", lon1="round9", inside="boolean")


_S = coords.series()
_TM = f"""SELECT id, {_S['a_bar']!r} * (eta + {" + ".join(f"{_S[f'a{j}']!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in range(1, 6))}) AS e, {_S['a_bar']!r} * (xi + {" + ".join(f"{_S[f'a{j}']!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in range(1, 6))}) - ({_S['s0']!r}) AS n
FROM (SELECT id, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM (SELECT id, sinh(atanh(sin(phi)) - {_S['e']!r} * atanh({_S['e']!r} * sin(phi))) AS tt, lam FROM (SELECT id, radians(lat) AS phi, radians(lon) - {_S['lon0']!r} AS lam FROM place)))"""


@query("x10_transverse_mercator", f"SELECT id, round(e, 4) AS e, round(n, 4) AS n FROM ({_TM})", ("place",))
def x10(t: Tables) -> DataFrame:
    """Degrees to plane metres."""
    d = t.place.select("id", coords.to_plane(c("lat"), c("lon")).alias("p")).select("id", "p.e", "p.n")
    return out(d, id="long", e="round4", n="round4")


@query(
    "x11_web_mercator_pixels",
    """SELECT id, floor(px)::BIGINT AS tile_px, floor(py)::BIGINT AS tile_py, floor(px / 256)::BIGINT AS tx, floor(py / 256)::BIGINT AS ty FROM
    (SELECT id, (lon + 180) / 360 * 8388608 AS px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8388608 AS py FROM place)""",
    ("place",),
)
def x11(t: Tables) -> DataFrame:
    d = t.place.select("id", coords.web_mercator(c("lon"), c("lat"), 15).alias("p")).select("id", F.floor("p.px").alias("tile_px"), F.floor("p.py").alias("tile_py"), F.floor(c("p.px") / 256).alias("tx"), F.floor(c("p.py") / 256).alias("ty"))
    return out(d, id="long", tile_px="long", tile_py="long", tx="long", ty="long")


@query(
    "x12_cells_and_street_frame",
    f"""SELECT id, round(x - 10, 6) AS cx, round(3 + 160 - y, 6) AS cz, floor(x - 10)::BIGINT AS ix, floor(163 - y)::BIGINT AS iz, round((x - 5) * {math.cos(0.3)!r} + (y - 7) * {math.sin(0.3)!r}, 6) AS u, round(-((x - 5) * -({math.sin(0.3)!r}) + (y - 7) * {math.cos(0.3)!r}), 6) AS v FROM point""",
    ("point",),
)
def x12(t: Tables) -> DataFrame:
    """Plane metres to cells that grow south, and the rotated street frame."""
    d = t.point.select("id", coords.plane_to_cell(c("x"), c("y"), 10, 3, 160).alias("p"), coords.rotated(c("x"), c("y"), 5, 7, 0.3).alias("f"))
    d = d.select("id", c("p.x").alias("cx"), c("p.z").alias("cz"), F.floor("p.x").alias("ix"), F.floor("p.z").alias("iz"), "f.u", "f.v")
    return out(d, id="long", cx="round6", cz="round6", ix="long", iz="long", u="round6", v="round6")


@query(
    "x13_bilinear_samples",
    """WITH g AS (SELECT x, z, max(y)::DOUBLE AS h FROM voxel GROUP BY x, z), s AS (SELECT DISTINCT id, x, y AS z, floor(x)::BIGINT AS i, floor(y)::BIGINT AS k FROM point)
    SELECT s.id, round((a.h * (1 - (s.x - i)) + b.h * (s.x - i)) * (1 - (s.z - k)) + (cc.h * (1 - (s.x - i)) + d.h * (s.x - i)) * (s.z - k), 6) AS h FROM s
    JOIN g a ON a.x = i AND a.z = k JOIN g b ON b.x = i + 1 AND b.z = k JOIN g cc ON cc.x = i AND cc.z = k + 1 JOIN g d ON d.x = i + 1 AND d.z = k + 1""",
    ("voxel", "point"),
)
def x13(t: Tables) -> DataFrame:
    """Heights between four pixels: one shuffle of samples to pixels, then one back to samples."""
    g = t.voxel.groupBy("x", "z").agg(F.max("y").cast("double").alias("h"))
    s = t.point.select("id", (c("x") - F.floor("x")).alias("fx"), (c("y") - F.floor("y")).alias("fz"), F.floor("x").alias("i"), F.floor("y").alias("k"))
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dz).alias("dz")) for dz in (0, 1) for dx in (0, 1)]))
    s = s.withColumn("o", corner).select("id", "i", "k", "fx", "fz", "o", (c("i") + c("o.dx")).alias("x"), (c("k") + c("o.dz")).alias("z"))
    w = F.when(c("o.dx") == 1, c("fx")).otherwise(1 - c("fx")) * F.when(c("o.dz") == 1, c("fz")).otherwise(1 - c("fz"))
    d = s.distinct().join(g, ["x", "z"]).groupBy("id", "i", "k", "fx", "fz").agg(F.sum(c("h") * w).alias("h"), F.count(F.lit(1)).alias("n")).filter("n = 4")
    return out(d, id="long", h="round6")


@query(
    "x14_roof_levels",
    """WITH k AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity / 3 AS h, greatest(1, least(504, ceil(l_quantity / 3 + 12) - 1))::BIGINT AS surf, greatest(1, least(504, ceil(l_extendedprice / 900 + 12) - 1))::BIGINT AS top0 FROM lineitem),
    s AS (SELECT *, greatest(top0, surf) AS top FROM k)
    SELECT l_orderkey, l_linenumber, surf, floor(h + 12)::BIGINT AS point_level, top, least(greatest(greatest(floor((top + 1) / 3.0::DOUBLE + 0.5)::BIGINT * 3, surf + 3) - 1, 1), 504) AS roof FROM s""",
)
def x14(t: Tables) -> DataFrame:
    """Surface and point levels by their two conventions, and roofs on whole floors."""
    k = lambda h: coords.clip(coords.surface_voxel(h), 1, 504).cast("long")
    d = t.lineitem.select("l_orderkey", "l_linenumber", (c("l_quantity") / 3).alias("h"), (c("l_extendedprice") / 900).alias("b")).withColumn("surf", k(c("h"))).withColumn("top", F.greatest(k(c("b")), c("surf")))
    d = d.select("l_orderkey", "l_linenumber", "surf", coords.point_voxel(c("h")).alias("point_level"), "top", coords.quantised_roof(c("top"), c("surf"), 3).alias("roof"))
    return out(d, l_orderkey="long", l_linenumber="long", surf="long", point_level="long", top="long", roof="long")


_RING = "o_orderkey AS id, [[0.0, 0.0, 0.0], [a, 0.0, b], [a, c, b + e], [0.0, c, e], [0.0, 0.0, 0.0]] AS p"


@query(
    "x15_f08_up_facing_rings",
    """WITH s AS (SELECT o_orderkey AS id, (1 + o_orderkey % 7)::DOUBLE AS a, (o_custkey % 9)::DOUBLE AS b, (1 + o_custkey % 5)::DOUBLE AS cc, (o_orderkey % 13)::DOUBLE AS e FROM orders),
    n AS (SELECT id, 0 - cc * b AS nx, 0 - a * e AS ny, a * cc AS nz FROM s), u AS (SELECT id, 2 * nx AS nx, 2 * ny AS ny, 2 * nz AS nz FROM n)
    SELECT id, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 9) AS up FROM u WHERE nz / sqrt(nx * nx + ny * ny + nz * nz) >= 0.3""",
)
def x15(t: Tables) -> DataFrame:
    """Normals of planar quadrilaterals by summing over their edges; those facing up are kept."""
    s = t.orders.select(c("o_orderkey").alias("id"), (1 + c("o_orderkey") % 7).cast("double").alias("a"), (c("o_custkey") % 9).cast("double").alias("b"), (1 + c("o_custkey") % 5).cast("double").alias("cc"), (c("o_orderkey") % 13).cast("double").alias("e"))
    pt = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    zero = F.lit(0.0)
    ring = F.array(pt(zero, zero, zero), pt(c("a"), zero, c("b")), pt(c("a"), c("cc"), c("b") + c("e")), pt(zero, c("cc"), c("e")), pt(zero, zero, zero))
    d = s.withColumn("ring", ring).select("id", coords.newell(c("ring")).alias("n"), coords.up_normal(c("ring")).alias("up")).filter("up >= 0.3")
    return out(d.select("id", "n.nx", "n.ny", "n.nz", "up"), id="long", nx="round6", ny="round6", nz="round6", up="round9")


@query(
    "x16_a16_unwrapped_boxes",
    """WITH p AS (SELECT o_custkey AS river, CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey * 13 % 3600) / 10.0::DOUBLE - 180 ELSE 170 + (o_orderkey % 50) / 10.0::DOUBLE END AS lon, (o_orderkey * 7 % 1200) / 10.0::DOUBLE - 60 AS lat FROM orders),
    s AS (SELECT river, max(lon) - min(lon) > 180 AS wide FROM p GROUP BY river), w AS (SELECT p.river, CASE WHEN wide AND lon < 0 THEN lon + 360 ELSE lon END AS lon, lat FROM p JOIN s USING (river))
    SELECT river, round(min(lon), 6) AS west, round(min(lat), 6) AS south, round(max(lon), 6) AS east, round(max(lat), 6) AS north FROM w GROUP BY river""",
)
def x16(t: Tables) -> DataFrame:
    """Boxes of point sets that may cross the antimeridian: both sides' extremes in one pass."""
    lon = F.when(c("o_custkey") % 3 == 0, (c("o_orderkey") * 13 % 3600) / 10.0 - 180).otherwise(170 + (c("o_orderkey") % 50) / 10.0)
    p = t.orders.select(c("o_custkey").alias("river"), lon.alias("lon"), ((c("o_orderkey") * 7 % 1200) / 10.0 - 60).alias("lat"))
    moved = F.when(c("lon") < 0, c("lon") + 360).otherwise(c("lon"))
    g = p.groupBy("river").agg(F.min("lon").alias("a"), F.max("lon").alias("b"), F.min(moved).alias("am"), F.max(moved).alias("bm"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    wide = c("b") - c("a") > 180
    return out(g.select("river", F.when(wide, c("am")).otherwise(c("a")).alias("west"), "south", F.when(wide, c("bm")).otherwise(c("b")).alias("east"), "north"), river="long", west="round6", south="round6", east="round6", north="round6")


@query(
    "x17_great_circles",
    """WITH s AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, sin(radians(lat)) AS y, -cos(radians(lat)) * sin(radians(lon)) AS z FROM place),
    j AS (SELECT a.id, a.x, a.y, a.z, b.x AS bx, b.y AS by_, b.z AS bz FROM s a JOIN s b ON b.id = a.id + 1), w AS (SELECT *, acos(least(1, greatest(-1, x * bx + y * by_ + z * bz))) AS w FROM j)
    SELECT id, round(w, 6) AS angle, round(CASE WHEN w < 1e-9 THEN x ELSE x * (sin(0.75 * w) / sin(w)) + bx * (sin(0.25 * w) / sin(w)) END, 8) AS qx, round(CASE WHEN w < 1e-9 THEN y ELSE y * (sin(0.75 * w) / sin(w)) + by_ * (sin(0.25 * w) / sin(w)) END, 8) AS qy FROM w""",
    ("place",),
)
def x17(t: Tables) -> DataFrame:
    """Angles between neighbours on the sphere, and a quarter of the way."""
    s = t.place.select("id", coords.on_sphere(c("lon"), c("lat")).alias("p"))
    j = s.join(s.select((c("id") - 1).alias("id"), c("p").alias("q")), "id")
    m = coords.slerp(c("p"), c("q"), F.lit(0.25))
    return out(j.select("id", coords.arc(c("p"), c("q")).alias("angle"), m["x"].alias("qx"), m["y"].alias("qy")), id="long", angle="round6", qx="round8", qy="round8")


@query(
    "x18_easings",
    """WITH u AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_discount * 10 AS t FROM lineitem), s AS (SELECT *, least(1, greatest(0, t)) AS q, least(1, greatest(0, (t - 0.6) / 0.32)) AS d FROM u)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN t < 0.5 THEN 4 * t * t * t ELSE 1 - pow(-2 * t + 2, 3) / 2 END, 9) AS ease, round(q * q * (3 - 2 * q), 9) AS smooth, round(3 - 2 * d * d * (3 - 2 * d), 9) AS detail FROM s""",
)
def x18(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("t"))
    return out(d.select("l_orderkey", "l_linenumber", curves.ease_in_out(c("t")).alias("ease"), curves.smoothstep(c("t")).alias("smooth"), curves.detail_scale(c("t")).alias("detail")), l_orderkey="long", l_linenumber="long", ease="round9", smooth="round9", detail="round9")


@query(
    "x19_flight_samples",
    """WITH f AS (SELECT o_orderkey AS id, 128.0::DOUBLE / (0.2 + (o_orderkey % 10) / 8.0::DOUBLE) * 1.5 AS w0, 128.0::DOUBLE / (0.2 + (o_custkey % 12) / 8.0::DOUBLE) * 1.5 AS w1, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE (o_totalprice / 40) * 1.2 END AS u1 FROM orders),
    b AS (SELECT *, greatest(u1, 1e-12) AS u, u1 < 1e-3 * least(w0, w1) AS zo FROM f),
    r AS (SELECT *, asinh(-(w1 * w1 - w0 * w0 + 3.8415999999999992 * u * u) / (2 * w0 * 1.9599999999999997 * u)) AS r0, asinh(-(w1 * w1 - w0 * w0 - 3.8415999999999992 * u * u) / (2 * w1 * 1.9599999999999997 * u)) AS r1 FROM b),
    l AS (SELECT *, CASE WHEN zo THEN abs(ln(w1 / w0)) / 1.4 ELSE (r1 - r0) / 1.4 END AS len FROM r),
    s AS (SELECT *, len * (i / 4.0::DOUBLE) AS s FROM l, (SELECT unnest(range(0, 5)) AS i))
    SELECT id, i::BIGINT AS i, round(least(4200, greatest(650, 600 + 430 * len)), 3) AS ms,
    round(CASE WHEN zo THEN CASE WHEN len > 0 THEN s / len ELSE 1 END ELSE least(1, greatest(0, w0 / 1.9599999999999997 * (cosh(r0) * tanh(1.4 * s + r0) - sinh(r0)) / u)) END, 6) AS frac,
    round(CASE WHEN zo THEN w0 * exp(sign(w1 - w0) * 1.4 * s) ELSE w0 * cosh(r0) / cosh(1.4 * s + r0) END, 3) AS width FROM s""",
)
def x19(t: Tables) -> DataFrame:
    """Five samples of each optimal pan-and-zoom path, pure zooms included."""
    w = lambda k, m: 128.0 / (0.2 + (c(k) % m) / 8.0) * 1.5
    f = t.orders.select(c("o_orderkey").alias("id"), w("o_orderkey", 10).alias("w0"), w("o_custkey", 12).alias("w1"), F.when(c("o_orderkey") % 17 == 0, 0.0).otherwise((c("o_totalprice") / 40) * 1.2).alias("u1"))
    f = f.withColumn("plan", curves.flight(c("w0"), c("w1"), c("u1"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    f = f.withColumn("at", curves.flight_at(c("plan"), c("w0"), c("w1"), c("u1"), c("plan.length") * (c("i") / 4.0)))
    return out(f.select("id", "i", curves.flight_ms(c("plan.length")).alias("ms"), "at.frac", "at.width"), id="long", i="long", ms="round3", frac="round6", width="round3")


@query("x20_view_scale", "SELECT event_id, round(900 / (128 / (0.1 + abs(value) / 50)), 8) AS ppm, round(CASE WHEN event_id % 4 = 0 THEN 30.0 ELSE 0.6 * value + 8 END, 8) AS eye FROM events")
def x20(t: Tables) -> DataFrame:
    d = t.events.select("event_id", curves.pixels_per_metre(F.lit(900.0), 0.1 + F.abs("value") / 50).alias("ppm"), curves.eye_height(F.when(c("event_id") % 4 != 0, c("value")), F.lit(30.0)).alias("eye"))
    return out(d, event_id="long", ppm="round8", eye="round8")


@query("x22_attribute_bytes", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, floor(l_discount * 10 * 255 + 0.5)::BIGINT AS byte FROM lineitem")
def x22(t: Tables) -> DataFrame:
    """0..1 to bytes, halves up."""
    return out(t.lineitem.select("l_orderkey", "l_linenumber", text.byte_of(c("l_discount") * 10).alias("byte")), l_orderkey="long", l_linenumber="long", byte="long")


@query("x23_hex_colours", "SELECT p_partkey, round((('0x' || substr(m, 1, 2))::BIGINT) / 255.0::DOUBLE, 9) AS r, round((('0x' || substr(m, 3, 2))::BIGINT) / 255.0::DOUBLE, 9) AS g, round((('0x' || substr(m, 5, 2))::BIGINT) / 255.0::DOUBLE, 9) AS b FROM (SELECT p_partkey, md5(p_name) AS m FROM part)")
def x23(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", text.hex_colour(F.concat(F.lit("#"), F.substring(F.md5("p_name"), 1, 6))).alias("k")).select("p_partkey", "k.r", "k.g", "k.b")
    return out(d, p_partkey="long", r="round9", g="round9", b="round9")


@query(
    "x24_crossfade_loop",
    f"""WITH x AS (SELECT l_orderkey AS track, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_discount * 10 - 0.5 AS v FROM lineitem),
    f AS (SELECT *, 2 AS k FROM x WHERE n >= 5), h AS (SELECT a.track, a.i, a.n, a.v * sin((a.i + 0.5) / 2 * {math.pi / 2!r}) + b.v * cos((a.i + 0.5) / 2 * {math.pi / 2!r}) AS v FROM f a JOIN f b ON a.track = b.track AND b.i = a.n - a.k + a.i WHERE a.i < 2
    UNION ALL SELECT track, i, n, v FROM f WHERE i >= 2 AND i < n - k)
    SELECT track, i::BIGINT AS i, round(v * pow(10, -6.0 / 20), 8) AS v FROM h""",
)
def x24(t: Tables) -> DataFrame:
    """A loop folded onto its own end with equal power over two samples, 6 dB down."""
    from gridspan.operators.signal import fold_loop, gain

    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    x = t.lineitem.select(c("l_orderkey").alias("track"), (F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"), (c("l_discount") * 10 - 0.5).alias("v")).filter("n >= 5")
    d = fold_loop(x.drop("n"), "track", 2).withColumn("v", c("v") * gain(F.lit(-6.0)))
    return out(d, track="long", i="long", v="round8")


@query(
    "x25_ordered_dither",
    """WITH b AS (SELECT * FROM (VALUES (0,0,0),(1,0,8),(2,0,2),(3,0,10),(0,1,12),(1,1,4),(2,1,14),(3,1,6),(0,2,3),(1,2,11),(2,2,1),(3,2,9),(0,3,15),(1,3,7),(2,3,13),(3,3,5)) t(bx, bz, rank))
    SELECT x, z, (max(y) / 16.0::DOUBLE > (any_value(rank) + 0.5) / 16) AS ink FROM voxel JOIN b ON x % 4 = bx AND z % 4 = bz GROUP BY x, z""",
    ("voxel",),
)
def x25(t: Tables) -> DataFrame:
    """Heights as ink through a 4 x 4 ordered-dither matrix."""
    from gridspan.operators.signal import bayer_rank

    g = t.voxel.groupBy("x", "z").agg((F.max("y") / 16.0).alias("v"))
    return out(g.select("x", "z", (c("v") > (bayer_rank(c("x"), c("z")) + 0.5) / 16).alias("ink")), x="long", z="long", ink="boolean")


@query("x01_text_cleaning", "SELECT p_partkey, trim(regexp_replace(p_name || ' [note ' || p_size || ']', '\\s*\\[.*?\\]', '', 'g')) AS name, p_size * 1000 + 7 AS km, trim(both '-' FROM regexp_replace(lower(split_part(p_type || '–' || p_brand, '–', 1)), '[^a-z0-9]+', '-', 'g')) AS slug, p_brand AS bare FROM part")
def x01(t: Tables) -> DataFrame:
    """Footnotes, grouped digits, slugs and parentheses."""
    with_note = F.concat(c("p_name"), F.lit(" [note "), c("p_size").cast("string"), F.lit("]"))
    grouped = F.concat(F.format_number(c("p_size") * 1000 + 7, 0), F.lit(" km"))
    d = t.part.select("p_partkey", text.without_footnotes(with_note).alias("name"), text.leading_integer(grouped).alias("km"), text.slug(F.concat(c("p_type"), F.lit("–"), c("p_brand"))).alias("slug"), text.without_parenthesis(F.concat(c("p_brand"), F.lit(" (x y)"))).alias("bare"))
    return out(d, p_partkey="long", name="string", km="long", slug="string", bare="string")


@query("x02_link_titles", "SELECT page_id, replace(split_part(regexp_replace(url, '^https?://[^/]*/', ''), '#', 1), '_', ' ') AS title, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages")
def x02(t: Tables) -> DataFrame:
    """Titles from links: prefix, fragment and underscores."""
    href = F.concat(F.lit("/wiki/"), F.regexp_replace("url", "^https?://[^/]*/", ""))
    d = t.pages.select("page_id", F.translate(text.link_title(href), "_", " ").alias("title"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return out(d, page_id="long", title="string", host="string")


@query("x03_clock_labels", "SELECT event_id, printf('%d:%04.1f', floor(s / 60)::INT, s - floor(s / 60) * 60) AS label, lpad((event_id % 1000)::VARCHAR, 3, '0') AS padded FROM (SELECT event_id, (event_id * 7 % 6000) / 4.0::DOUBLE AS s FROM events)")
def x03(t: Tables) -> DataFrame:
    d = t.events.select("event_id", text.clock((c("event_id") * 7 % 6000) / 4.0).alias("label"), F.lpad((c("event_id") % 1000).cast("string"), 3, "0").alias("padded"))
    return out(d, event_id="long", label="string", padded="string")


@query("x04_filled_templates", "SELECT p_partkey, 'A ' || p_type || ' by ' || p_brand || ', size ' || p_size || ' (' || p_brand || ').' AS prompt FROM part")
def x04(t: Tables) -> DataFrame:
    d = t.part.select("p_partkey", text.filled("A {type} by {brand}, size {size} ({brand}).", {"type": c("p_type"), "brand": c("p_brand"), "size": c("p_size").cast("string")}).alias("prompt"))
    return out(d, p_partkey="long", prompt="string")


@query("x05_coordinate_lists", "SELECT o_orderkey, 2::BIGINT AS n, round(o_orderkey / 8.0::DOUBLE, 6) AS x0, round(o_custkey / 4.0::DOUBLE, 6) AS y1 FROM orders")
def x05(t: Tables) -> DataFrame:
    """Position lists as text, to points."""
    pos = F.concat_ws("  ", (c("o_orderkey") / 8.0).cast("string"), F.lit("1"), F.lit("2.5"), F.lit("7"), (c("o_custkey") / 4.0).cast("string"), F.lit("-3e1"))
    d = t.orders.select("o_orderkey", text.points(pos).alias("p"))
    return out(d.select("o_orderkey", F.size("p").alias("n"), c("p")[0]["x"].alias("x0"), c("p")[1]["y"].alias("y1")), o_orderkey="long", n="long", x0="round6", y1="round6")


@query("x27_span_expansion", "SELECT x, z, y, cls FROM (SELECT x, z, min(y) AS y0, max(y) AS y1, max(cls) AS cls FROM voxel GROUP BY x, z) s, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) e", ("voxel",))
def x27(t: Tables) -> DataFrame:
    """Column spans to cells."""
    s = t.voxel.groupBy("x", "z").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("cls").alias("cls"))
    return out(s.withColumn("y", F.explode(F.sequence("y0", "y1"))), x="long", z="long", y="long", cls="long")


@query("x28_json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS made FROM events")
def x28(t: Tables) -> DataFrame:
    """JSON parsed with a declared schema, and built."""
    d = t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(c("event_id").alias("id"), c("event_type").alias("type"))).alias("made"))
    return out(d, event_id="long", k="long", made="string")


@query(
    "x29_page_scales",
    """WITH b AS (SELECT river, min(least(lon0, lon1)) AS lo, max(greatest(lon0, lon1)) AS hi, min(least(lat0, lat1)) AS la, max(greatest(lat0, lat1)) AS lb FROM line_end GROUP BY river),
    s AS (SELECT *, 0.01 / greatest(cos(radians((la + lb) / 2)), 0.25) AS dx, 0.01 AS dy FROM b), k AS (SELECT *, greatest(1, (hi - lo) / dx / 500, (lb - la) / dy / 500) AS sc FROM s)
    SELECT river, round(sc, 6) AS scale, (ceil(round((hi - lo) / (dx * sc), 6)) + 9)::BIGINT AS w, (ceil(round((lb - la) / (dy * sc), 6)) + 9)::BIGINT AS h FROM k""",
    ("line_end",),
)
def x29(t: Tables) -> DataFrame:
    """Pixel sizes of drawn rivers: longitude widened by latitude, scaled down to fit a page."""
    b = t.line_end.groupBy("river").agg(F.min(F.least("lon0", "lon1")).alias("lo"), F.max(F.greatest("lon0", "lon1")).alias("hi"), F.min(F.least("lat0", "lat1")).alias("la"), F.max(F.greatest("lat0", "lat1")).alias("lb"))
    s = b.withColumn("dx", 0.01 / F.greatest(F.cos(F.radians((c("la") + c("lb")) / 2)), F.lit(0.25)))
    s = s.withColumn("scale", F.greatest(F.lit(1.0), (c("hi") - c("lo")) / c("dx") / 500, (c("lb") - c("la")) / 0.01 / 500))
    side = lambda span, step: F.ceil(F.round(span / (step * c("scale")), 6)) + 9
    return out(s.select("river", "scale", side(c("hi") - c("lo"), c("dx")).alias("w"), side(c("lb") - c("la"), F.lit(0.01)).alias("h")), river="long", scale="round6", w="long", h="long")


@query("f04_f03_building_heights", "SELECT o_orderkey, (CASE o_orderkey % 5 WHEN 0 THEN 12.5 WHEN 1 THEN 9.0 WHEN 2 THEN 15.0 WHEN 3 THEN 9.0 END)::DOUBLE AS height, o_orderkey % 5 < 2 AS explicit, o_orderkey % 5 = 4 AS guessed FROM orders")
def f04(t: Tables) -> DataFrame:
    """Heights from loose tags: height, levels, kind, then a hashed guess of two or three floors (its value
    is unit-tested; here only that it is one of them)."""
    from gridspan.operators.osm import building_height

    k = c("o_orderkey") % 5
    tags = F.map_filter(
        F.create_map(F.lit("height"), F.when(k == 0, F.lit("12,5 m")).when(k == 1, F.lit("0")), F.lit("building:levels"), F.when(k == 1, F.lit("3")), F.lit("building"), F.when(k == 2, F.lit("apartments")).when(k == 3, F.lit("school")).otherwise(F.lit("yes"))),
        lambda _, v: v.isNotNull(),
    )
    d = t.orders.select("o_orderkey", building_height(F.concat(F.lit("way"), c("o_orderkey").cast("string")), tags).alias("h"))
    guess = (k == 4) & c("h.height").isin(6.0, 9.0)
    return out(d.select("o_orderkey", F.when(k < 4, c("h.height")).alias("height"), "h.explicit", guess.alias("guessed")), o_orderkey="long", height="double", explicit="boolean", guessed="boolean")
