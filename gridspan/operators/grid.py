"""Cells of a metre grid: spatial joins by bins, rasters, painting, merging, voxel pyramids and faces.

A bounding-box or distance join would plan as a nested loop over all pairs; here every shape is exploded
to the cells or bins it can touch, which makes an equi-join that hash-partitions, and the exact test
filters what is left.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Classes of cells (fixed values).
AIR, GROUND, ROAD, SIDEWALK, BUILDING, ROOF, VEG, POLE, WATER, RAIL, BRIDGE, FURNITURE, FENCE = range(13)
CLASS_NAMES = ["air", "ground", "road", "sidewalk", "building", "roof", "vegetation", "pole", "water", "rail", "bridge", "furniture", "fence"]
#: Which class wins a block, first the thin things.
WINNERS = [POLE, FURNITURE, FENCE, VEG, ROOF, BUILDING, BRIDGE, RAIL, WATER, SIDEWALK, ROAD, GROUND]
THIN_RANK, VEG_RANK = 2, 3
TERRAIN = [GROUND, ROAD, SIDEWALK, WATER, RAIL, BRIDGE]


def rank_of(cls: Column) -> Column:
    """Place in WINNERS; unknown classes come last."""
    out = None
    for i, k in enumerate(WINNERS):
        out = F.when(cls == k, i) if out is None else out.when(cls == k, i)
    return out.otherwise(len(WINNERS))


def class_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in [*WINNERS, AIR]]), (rank + 1).cast("int"))


def offsets(*ranges: range) -> Column:
    """array<struct<dx,dz[,dy]>> of all combinations, to explode."""
    names = ["dx", "dz", "dy"]
    combos: list[list[int]] = [[]]
    for r in ranges:
        combos = [[*p, i] for p in combos for i in r]
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, p, strict=False)]) for p in combos])


# --- spatial joins ----------------------------------------------------------------------------------------


def polygon_cells(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, x, z): cells whose centre is in the closed ring array<struct<x,z>> by the even-odd rule;
    rings of holes may follow in the same array of rings. The ray test is an aggregate over the edges
    that reach a row of cells, so a large polygon is spread over its rows."""
    e = polygons.select(key, F.explode(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: F.struct(p["x"].alias("x0"), p["z"].alias("z0"), q["x"].alias("x1"), q["z"].alias("z1")))).alias("e")).select(key, "e.*")
    e = e.filter("z0 <> z1").withColumn("lo", F.least("z0", "z1")).withColumn("hi", F.greatest("z0", "z1"))
    # rows z with lo <= z + 0.5 < hi
    first, last = F.ceil(c("lo") - 0.5).cast("long"), (F.ceil(c("hi") - 0.5) - 1).cast("long")
    rows = e.filter(first <= last).withColumn("z", F.explode(F.sequence(first, last)))
    cross = rows.withColumn("at", c("x0") + (c("z") + 0.5 - c("z0")) * (c("x1") - c("x0")) / (c("z1") - c("z0")))
    # crossings in pairs along a row bound the inside
    w = Window.partitionBy(key, "z").orderBy("at")
    pair = cross.withColumn("n", F.row_number().over(w)).withColumn("end", F.lead("at").over(w)).filter("n % 2 = 1 AND end IS NOT NULL")
    a, b = F.ceil(c("at") - 0.5).cast("long"), (F.ceil(c("end") - 0.5) - 1).cast("long")
    return pair.filter(a <= b).select(key, F.explode(F.sequence(a, b)).alias("x"), "z")


def triangle_cells(tris: DataFrame, order: str, small: int = 10) -> DataFrame:
    """(x, z, h): heights of triangles (x0, z0, h0, ... h2) at the cell centres they hold. Where several
    do, the last painted stays: small triangles before large ones, the small by offset in their box."""
    lo = lambda k: F.ceil(F.least(f"{k}0", f"{k}1", f"{k}2") - 0.5).cast("long")
    hi = lambda k: F.floor(F.greatest(f"{k}0", f"{k}1", f"{k}2") - 0.5).cast("long")
    d = tris.withColumn("det", (c("z1") - c("z2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("z0") - c("z2")))
    d = d.withColumn("i0", lo("x")).withColumn("i1", hi("x")).withColumn("j0", lo("z")).withColumn("j1", hi("z")).filter("abs(det) > 1e-9 AND i1 >= i0 AND j1 >= j0")
    large = (c("i1") - c("i0") + 1 > small) | (c("j1") - c("j0") + 1 > small)
    d = d.withColumn("large", large).withColumn("x", F.explode(F.sequence("i0", "i1"))).withColumn("z", F.explode(F.sequence("j0", "j1")))
    px, pz = c("x") + 0.5, c("z") + 0.5
    l0 = ((c("z1") - c("z2")) * (px - c("x2")) + (c("x2") - c("x1")) * (pz - c("z2"))) / c("det")
    l1 = ((c("z2") - c("z0")) * (px - c("x2")) + (c("x0") - c("x2")) * (pz - c("z2"))) / c("det")
    d = d.withColumn("l0", l0).withColumn("l1", l1).withColumn("l2", 1 - c("l0") - c("l1")).filter("l0 >= -1e-9 AND l1 >= -1e-9 AND l2 >= -1e-9")
    h = c("l0") * c("h0") + c("l1") * c("h1") + c("l2") * c("h2")
    painted = F.struct(c("large"), F.when(c("large"), 0).otherwise(c("x") - c("i0")).alias("di"), F.when(c("large"), 0).otherwise(c("z") - c("j0")).alias("dj"), c(order))
    return d.groupBy("x", "z").agg(F.max_by(h, painted).alias("h"))


def tin_heights(tris: DataFrame, order: str, targets: DataFrame) -> DataFrame:
    """(x, z, h) of all target cells: on a triangle where one covers the centre, else of the nearest
    covered cell."""
    on = triangle_cells(tris, order).join(targets.select("x", "z"), ["x", "z"], "left_semi")
    off = targets.select("x", "z").join(on.select("x", "z"), ["x", "z"], "left_anti")
    return on.unionByName(nearest_fill(on, off).select("x", "z", "h"))


def plane_fit(points: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c0) of the least-squares plane z = a x + b y + c0; null where points are in a line."""
    g = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"))
    det = c("xx") * c("yy") - c("xy") * c("xy")
    ok = det > 1e-12 * F.greatest(c("xx") * c("yy"), F.lit(1e-300))
    a, b = (c("xz") * c("yy") - c("yz") * c("xy")) / det, (c("yz") * c("xx") - c("xz") * c("xy")) / det
    return g.select(key, F.when(ok, a).alias("a"), F.when(ok, b).alias("b"), F.when(ok, c("mz") - a * c("mx") - b * c("my")).alias("c0"))


def blocks_near(points: DataFrame, side: int, radius: float) -> DataFrame:
    """(bx, bz): blocks of ``side`` cells within ``radius`` of a point (x, z), by their nearest edge."""
    reach = int(radius // side) + 1
    d = points.select("x", "z", F.explode(offsets(range(-reach, reach + 1), range(-reach, reach + 1))).alias("o"))
    d = d.select("x", "z", (F.floor(c("x") / side) + c("o.dx")).alias("bx"), (F.floor(c("z") / side) + c("o.dz")).alias("bz"))
    gap = lambda p, b: F.greatest(c(b) * side - c(p), c(p) - (c(b) + 1) * side, F.lit(0.0))
    return d.filter(gap("x", "bx") * gap("x", "bx") + gap("z", "bz") * gap("z", "bz") <= radius * radius).select("bx", "bz").distinct()


def boxes_meeting(boxes: DataFrame, areas: DataFrame, side: float, touching: bool = True) -> DataFrame:
    """(box, area): boxes (box, x0, y0, x1, y1) that meet areas (area, x0, y0, x1, y1); ``touching``: with
    only an edge in common too. Both are spread over bins of ``side``; a pair is taken in one bin alone,
    that of its common part's low corner, so nothing is counted twice."""
    bin_of = lambda v: F.floor(c(v) / side).cast("long")
    spread = lambda d: d.withColumn("bx", F.explode(F.sequence(bin_of("x0"), bin_of("x1")))).withColumn("by", F.explode(F.sequence(bin_of("y0"), bin_of("y1"))))
    a = spread(areas.select("area", *[c(k) for k in ("x0", "y0", "x1", "y1")])).select("area", "bx", "by", *[c(k).alias("a" + k) for k in ("x0", "y0", "x1", "y1")])
    d = spread(boxes.select("box", "x0", "y0", "x1", "y1")).join(a, ["bx", "by"])
    own = (c("bx") == F.floor(F.greatest("x0", "ax0") / side)) & (c("by") == F.floor(F.greatest("y0", "ay0") / side))
    less = (lambda p, q: c(p) <= c(q)) if touching else (lambda p, q: c(p) < c(q))
    return d.filter(own & less("x0", "ax1") & less("ax0", "x1") & less("y0", "ay1") & less("ay0", "y1")).select("box", "area")


def _nearest_in_row(at: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x the index of the nearest of the rising positions ``at``, the smaller of two."""
    i = np.searchsorted(at, x)
    before, after = np.maximum(i - 1, 0), np.minimum(i, len(at) - 1)
    return np.where(np.abs(x - at[before]) <= np.abs(at[after] - x), before, after)


def _nearest_in_column(z: np.ndarray, rows: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """For each z the index of the row with the least (z - row)^2 + d2, the first of equals. ``rows`` rise;
    each step looks one row further out on both sides, until no row beyond can be nearer."""
    start = np.searchsorted(rows, z)
    best = np.full(len(z), np.iinfo(np.int64).max)
    pick, open_ = np.zeros(len(z), dtype=np.int64), np.arange(len(z))
    step = 0
    while len(open_):
        beyond = np.ones(len(open_), dtype=bool)
        for i, first in ((start[open_] - 1 - step, True), (start[open_] + step, False)):
            there = np.flatnonzero((i >= 0) & (i < len(rows)))
            t, r = open_[there], i[there]
            gap = (z[t] - rows[r]) ** 2
            d = gap + d2[r]
            better = (d <= best[t]) if first else (d < best[t])
            best[t[better]], pick[t[better]] = d[better], r[better]
            beyond[there[gap < best[t] + first]] = False
        open_, step = open_[~beyond], step + 1
    return pick


def nearest_fill(cells: DataFrame, targets: DataFrame, required: bool = True) -> DataFrame:
    """(x, z, h, d2): every target cell's nearest known cell (x, z, h); ties go to the smaller z, then x.
    Targets without any known cell are an error, or left out where none is ``required``.

    A squared distance is separable. First every row that holds known cells gives, for each x of the
    targets' extent, its nearest known cell; then every column finds, for its targets, the nearest of its
    rows' answers. Two exchanges, by row and by column; a task holds a row or a column, never the grid.
    Between them there are (rows with known cells) x (extent in x) rows of 32 bytes.
    """
    kind = cells.schema["h"].dataType.simpleString()
    span = targets.agg(F.min("x").cast("long").alias("lo"), F.max("x").cast("long").alias("hi")).first()
    lo, hi = (0, -1) if span.lo is None else (span.lo, span.hi)
    row = cells.select(c("x").cast("long").alias("x"), c("z").cast("long").alias("kz"), "h")

    def in_row(table: pa.Table) -> pa.Table:
        t = table.sort_by("x")
        at, x = t["x"].to_numpy(), np.arange(lo, hi + 1)
        i = _nearest_in_row(at, x)
        return pa.table([pa.array(x, pa.int64()), pa.array(np.full(len(x), t["kz"][0].as_py()), pa.int64()), pa.array(at[i], pa.int64()), t["h"].take(pa.array(i))], names=["x", "kz", "kx", "h"])

    near = row.groupBy("kz").applyInArrow(in_row, f"x long, kz long, kx long, h {kind}")
    both = near.unionByName(targets.select(c("x").cast("long").alias("x"), c("z").cast("long").alias("kz"), F.lit(None).cast("long").alias("kx"), F.lit(None).cast(kind).alias("h")).distinct())

    def in_column(table: pa.Table) -> pa.Table:
        t = table.sort_by("kz")
        kx, kz = t["kx"], t["kz"].to_numpy()
        given = np.asarray(kx.is_valid())
        z, rows_ = kz[~given], kz[given]
        if len(z) and not len(rows_):
            if required:
                raise RuntimeError("targets without a known cell")
            z = z[:0]
        x = t["x"][0].as_py()
        far = (np.asarray(kx.drop_null()) - x) ** 2
        i = _nearest_in_column(z, rows_, far) if len(z) else np.empty(0, dtype=np.int64)
        h = t["h"].filter(pa.array(given)).take(pa.array(i))
        return pa.table([pa.array(np.full(len(z), x), pa.int64()), pa.array(z, pa.int64()), h, pa.array((z - rows_[i]) ** 2 + far[i], pa.int64())], names=["x", "z", "h", "d2"])

    return both.groupBy("x").applyInArrow(in_column, f"x long, z long, h {kind}, d2 long")


def offsets_square(r: int) -> Column:
    side = F.sequence(F.lit(-r).cast("long"), F.lit(r).cast("long"))
    return F.flatten(F.transform(side, lambda i: F.transform(side, lambda j: F.struct(i.alias("dx"), j.alias("dz")))))


def _has_checkpoint(df: DataFrame) -> bool:
    return df.sparkSession.sparkContext.getCheckpointDir() is not None


def within(targets: DataFrame, marks: DataFrame, radius: float) -> DataFrame:
    """(x, z, d2) of cells no farther than a small radius from a marked cell: exact, by offsets."""
    r = int(radius)
    near = F.filter(offsets_square(r), lambda o: o["dx"] * o["dx"] + o["dz"] * o["dz"] <= radius * radius)
    around = marks.select("x", "z", F.explode(near).alias("o")).select((c("x") + c("o.dx")).alias("x"), (c("z") + c("o.dz")).alias("z"), (c("o.dx") * c("o.dx") + c("o.dz") * c("o.dz")).alias("d2"))
    return around.groupBy("x", "z").agg(F.min("d2").alias("d2")).join(targets.select("x", "z").distinct(), ["x", "z"], "left_semi")


def nearest_of_class(points: DataFrame, tops: DataFrame, classes: list[int], radius: int = 6) -> DataFrame:
    """(id, x, z, top, building): of each point (id, px, pz) the nearest column whose top class is
    wanted, by its centre, at most ``radius`` away; the first in (dz, dx) order wins a tie. Without any,
    the point's own column. Points given as decimals keep them: differences are exact and rounded once."""
    half, cell = F.lit(Decimal("0.5")), lambda p: F.floor(p).cast("long")
    t = points.select("id", "px", "pz", F.explode(offsets_square(radius)).alias("o")).select("id", "px", "pz", "o", (cell("px") + c("o.dx")).alias("x"), (cell("pz") + c("o.dz")).alias("z"))
    j = t.join(tops, ["x", "z"])
    apart = lambda k: (c(k) + half - c("p" + k)).cast("double")
    d2 = apart("x") * apart("x") + apart("z") * apart("z")
    hit = j.withColumn("d2", d2).filter(c("top_class").isin(classes) & (c("d2") <= radius * radius)).groupBy("id").agg(F.min(F.struct(F.sqrt("d2").alias("d"), "o.dz", "o.dx", "x", "z", "top")).alias("m"))
    own = points.withColumn("x", cell("px")).withColumn("z", cell("pz")).join(tops.select("x", "z", "ground"), ["x", "z"], "left")
    out = own.join(hit, "id", "left")
    return out.select("id", F.when(c("m").isNotNull(), c("m.x") + half).otherwise(c("px")).alias("ax"), F.when(c("m").isNotNull(), c("m.z") + half).otherwise(c("pz")).alias("az"), F.when(c("m").isNotNull(), c("m.top")).otherwise(F.coalesce("ground", F.lit(0))).alias("y"), c("m").isNotNull().alias("building"))


def close_pairs(points: DataFrame, group: str, radius: float) -> DataFrame:
    """(group, i, j, d): pairs of points (id, x, y) of one group nearer than the radius, i < j. Points
    meet in bins of the radius' size; one side looks into the bins around."""
    p = points.withColumn("bx", F.floor(c("x") / radius)).withColumn("by", F.floor(c("y") / radius))
    o = p.select(group, c("id").alias("j"), c("x").alias("x2"), c("y").alias("y2"), F.explode(offsets(range(-1, 2), range(-1, 2))).alias("o"), "bx", "by").select(group, "j", "x2", "y2", (c("bx") + c("o.dx")).alias("bx"), (c("by") + c("o.dz")).alias("by"))
    d = p.join(o, [group, "bx", "by"]).filter(c("id") < c("j")).withColumn("d", F.sqrt((c("x") - c("x2")) * (c("x") - c("x2")) + (c("y") - c("y2")) * (c("y") - c("y2"))))
    return d.filter(c("d") < radius).select(group, c("id").alias("i"), "j", "d")


def lamp_light(vertices: DataFrame, lamps: DataFrame, radius: float) -> DataFrame:
    """(id, light): at each vertex (id, x, y, z, fx, fy, fz the face's direction) the sum over lamps
    nearer than the radius of a squared falloff, by how squarely the face looks at the lamp; at most 1."""
    v = vertices.withColumn("bi", F.floor(c("x") / radius)).withColumn("bk", F.floor(c("z") / radius))
    steps = F.explode(offsets(range(-1, 2), range(-1, 2)))
    m = lamps.select(c("x").alias("lx"), c("y").alias("ly"), c("z").alias("lz"), steps.alias("o")).select("lx", "ly", "lz", (F.floor(c("lx") / radius) + c("o.dx")).alias("bi"), (F.floor(c("lz") / radius) + c("o.dz")).alias("bk"))
    j = v.join(m, ["bi", "bk"])
    dx, dy, dz = c("lx") - c("x"), c("ly") - c("y"), c("lz") - c("z")
    j = j.withColumn("d", F.sqrt(dx * dx + dy * dy + dz * dz)).filter(c("d") < radius)
    facing = F.when(c("d") < 1e-4, 1.0).otherwise((dx * c("fx") + dy * c("fy") + dz * c("fz")) / c("d"))
    w = F.least(F.greatest(facing * 0.8 + 0.35, F.lit(0.0)), F.lit(1.0))
    a = 1 - c("d") / radius
    s = j.groupBy("id").agg(F.least(F.sum(a * a * w), F.lit(1.0)).alias("light"))
    return vertices.select("id").join(s, "id", "left").select("id", F.coalesce("light", F.lit(0.0)).alias("light"))


def segment_cells(segments: DataFrame, key: str, half_width: str) -> DataFrame:
    """(key, x, z): cells whose centre is within half a width of a segment (x0, z0, x1, z1), ends flat."""
    w = c(half_width)
    a = lambda p, q: F.floor(F.least(p, q) - w).cast("long")
    b = lambda p, q: F.ceil(F.greatest(p, q) + w).cast("long")
    d = segments.withColumn("x", F.explode(F.sequence(a("x0", "x1"), b("x0", "x1")))).withColumn("z", F.explode(F.sequence(a("z0", "z1"), b("z0", "z1"))))
    dx, dz = c("x1") - c("x0"), c("z1") - c("z0")
    size2 = dx * dx + dz * dz
    px, pz = c("x") + 0.5 - c("x0"), c("z") + 0.5 - c("z0")
    along, across = (px * dx + pz * dz) / size2, F.abs(px * dz - pz * dx) / F.sqrt(size2)
    return d.filter((size2 > 0) & (along >= 0) & (along <= 1) & (across <= w)).select(key, "x", "z").distinct()


def line_cells(segments: DataFrame, key: str) -> DataFrame:
    """(key, x, z): pixels of 1-wide segments between integer ends, one for each step of the longer axis."""
    n = F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("z1") - c("z0")))
    d = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))))
    at = lambda p, q: (c(p) + F.when(c("n") == 0, 0.0).otherwise(F.floor((c(q) - c(p)) * c("i") / c("n") + 0.5))).cast("long")
    return d.select(key, at("x0", "x1").alias("x"), at("z0", "z1").alias("z")).distinct()


def ray_hits(rays: DataFrame, tops: DataFrame, step: float, steps: int) -> DataFrame:
    """(id, hidden): whether a ray (id, x, y, z, vx, vy, vz) is under a column's top at any step."""
    s = rays.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select("id", F.floor(c("x") + c("vx") * c("k") * step).alias("x"), (c("y") + c("vy") * c("k") * step).alias("at"), F.floor(c("z") + c("vz") * c("k") * step).alias("z"))
    return s.join(tops, ["x", "z"], "left").groupBy("id").agg(F.coalesce(F.bool_or(c("at") < c("top")), F.lit(False)).alias("hidden"))


# --- rasters ----------------------------------------------------------------------------------------------


def neighbourhood(cells: DataFrame, radius: int, agg: Column, edge: tuple[int, int] | None = None) -> DataFrame:
    """(x, z, out): an aggregate over ``w``, the values (x, z, v) in the square around each cell. With
    ``edge`` = (nx, nz) coordinates beyond the grid take the nearest cell's value."""
    o = F.explode(offsets_square(radius))
    if edge is None:
        d = cells.select("x", "z", "v", o.alias("o")).select((c("x") + c("o.dx")).alias("x"), (c("z") + c("o.dz")).alias("z"), c("v").alias("w"))
        return d.groupBy("x", "z").agg(agg.alias("out")).join(cells.select("x", "z"), ["x", "z"], "left_semi")
    d = cells.select("x", "z", o.alias("o")).select("x", "z", clamp(c("x") + c("o.dx"), edge[0]).alias("sx"), clamp(c("z") + c("o.dz"), edge[1]).alias("sz"))
    return d.join(cells.select(c("x").alias("sx"), c("z").alias("sz"), c("v").alias("w")), ["sx", "sz"]).groupBy("x", "z").agg(agg.alias("out"))


def clamp(v: Column, n: int) -> Column:
    return F.least(F.greatest(v, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))


def diffuse_fill(cells: DataFrame, targets: DataFrame, rounds: int = 200) -> DataFrame:
    """(x, z, v): unknown target cells get the mean of known neighbours in 3 x 3, again and again."""
    known = cells.select("x", "z", "v")
    left = targets.select("x", "z").join(known, ["x", "z"], "left_anti")
    for _ in range(rounds):
        spread = known.select("v", "x", "z", F.explode(offsets_square(1)).alias("o")).select((c("x") + c("o.dx")).alias("x"), (c("z") + c("o.dz")).alias("z"), "v")
        new = spread.join(left, ["x", "z"], "left_semi").groupBy("x", "z").agg(F.avg("v").alias("v"))
        new = new.checkpoint() if _has_checkpoint(new) else new.persist()
        if new.isEmpty():
            if left.isEmpty():
                return known
            raise RuntimeError("cells that no known cell reaches")
        known = known.unionByName(new)
        left = left.join(new.select("x", "z"), ["x", "z"], "left_anti")
        left = left.checkpoint() if _has_checkpoint(left) else left.persist()
        if left.isEmpty():
            return known
    raise RuntimeError("the fill did not end")


def last_painted(paint: DataFrame, order: list[str]) -> DataFrame:
    """(x, z, cls): of all strokes on a cell the last in the given order."""
    return paint.groupBy("x", "z").agg(F.max_by("cls", F.struct(*order)).alias("cls"))


def merged_tiles(tiles: DataFrame) -> DataFrame:
    """(x, z, h, w, bh, deck, rc, rc_lod, cover) of overlapping tiles: the first known ground and water,
    the highest roof and deck, the finest surface class (the latest of equals), any cover. What is
    painted (rc > 0) without a level gives way to any level."""
    first = lambda n: F.min_by(n, F.when(c(n).isNotNull(), c("tile"))).alias(n)
    rank = F.when(c("rc") > 0, F.struct("rc_lod", "tile"))
    return tiles.groupBy("x", "z").agg(first("h"), first("w"), F.max("bh").alias("bh"), F.max("deck").alias("deck"), F.coalesce(F.max_by("rc", rank), F.lit(0)).alias("rc"), F.coalesce(F.max_by("rc_lod", rank), F.lit(0)).alias("rc_lod"), F.bool_or("cover").alias("cover"))


def column_spans(samples: DataFrame, fill: bool) -> DataFrame:
    """(x, z, y0, y1, cls) of sampled voxels (feature, x, z, k, cls): filled columns, or single voxels."""
    if fill:
        return samples.groupBy("feature", "x", "z", "cls").agg(F.min("k").alias("y0"), F.max("k").alias("y1")).select("x", "z", "y0", "y1", "cls").distinct()
    return samples.select("x", "z", c("k").alias("y0"), c("k").alias("y1"), "cls").distinct()


def composed(layers: DataFrame, spans: DataFrame, roof_step: int = 1) -> DataFrame:
    """(x, y, z, cls): voxels of merged layers (x, z, h, w, bh, deck, rc, cover), h filled.

    Ground below the surface, then surface, building from the surface up, roof, deck, and spans, of which
    the last in (y0, y1, cls) stays: the highest of those on a cell.
    """
    from gridspan.functions.coords import NY_MAX, clip, quantised_roof, surface_voxel

    k = lambda n, low: clip(surface_voxel(F.coalesce(c(n), F.lit(0.0))), low, NY_MAX - 8).cast("long")
    water = c("w").isNotNull() & (c("known_h").isNull() | (c("known_h") <= c("w") + 0.5))
    d = layers.filter("cover").withColumn("water", water).withColumn("surf", F.when(c("water"), k("w", 1)).otherwise(k("h", 1)))
    d = d.withColumn("surf_cls", F.when(c("rc") > 0, c("rc")).when(c("water"), WATER).otherwise(GROUND))
    top = clip(F.greatest(surface_voxel(F.coalesce("bh", F.lit(0.0))), c("surf")), 1, NY_MAX - 8).cast("long")
    d = d.withColumn("top", F.when(c("bh").isNotNull(), quantised_roof(top, c("surf"), roof_step))).withColumn("dk", F.when(c("deck").isNotNull(), k("deck", 0)))
    run = lambda a, b, cls, prio: F.struct(a.cast("long").alias("y0"), b.cast("long").alias("y1"), cls.cast("long").alias("cls"), F.lit(prio).alias("prio"))
    zero = F.lit(0)
    runs = F.array(
        F.when(c("surf") > 0, run(zero, c("surf") - 1, F.lit(GROUND), 0)),
        run(c("surf"), c("surf"), c("surf_cls"), 1),
        F.when(c("top").isNotNull(), run(c("surf"), c("top"), F.lit(BUILDING), 2)),
        F.when(c("top").isNotNull(), run(c("top"), c("top"), F.lit(ROOF), 3)),
        F.when(c("dk").isNotNull(), run(c("dk"), c("dk"), F.lit(BRIDGE), 4)),
    )
    solid = d.select("x", "z", F.explode(F.filter(runs, lambda r: r.isNotNull())).alias("r")).select("x", "z", "r.*")
    thin = spans.select("x", "z", c("y0").cast("long").alias("y0"), c("y1").cast("long").alias("y1"), c("cls").cast("long").alias("cls"), F.lit(5).alias("prio"))
    cells = solid.unionByName(thin).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return cells.groupBy("x", "y", "z").agg(F.max_by("cls", F.struct("prio", "y0", "y1", "cls")).alias("cls"))


# --- pyramid and chunks -------------------------------------------------------------------------------------


def pool_majority(voxels: DataFrame, level: int) -> DataFrame:
    """(x, y, z, cls) at half the size. A block of 8 is solid when four are; thin things survive only to
    level 1 and are taken out before counting from level 2; foliage needs two. The least rank wins."""
    ranked = voxels.select("x", "y", "z", rank_of(c("cls")).alias("rank"))
    if level >= 2:
        ranked = ranked.filter(c("rank") > THIN_RANK)
    g = ranked.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"), F.shiftright("z", 1).alias("z")).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    solid = (c("n") >= 4) | ((c("rank") == VEG_RANK) & (c("n") >= 2))
    if level == 1:
        solid = solid | (c("rank") <= THIN_RANK)
    return g.filter(solid).select("x", "y", "z", class_of_rank(c("rank")).cast("long").alias("cls"))


def pyramid(voxels: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, z, cls) of all levels; each is one shuffle of what the level below kept."""
    now = voxels.select("x", "y", "z", "cls")
    out = now.withColumn("level", F.lit(0))
    for level in range(1, levels):
        now = pool_majority(now, level)
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out


def pool_priority(voxels: DataFrame, k: int) -> DataFrame:
    """(x, y, z, cls): blocks of k by class priority alone."""
    down = lambda n: F.floor(c(n) / k).cast("long").alias(n)
    g = voxels.select(down("x"), down("y"), down("z"), rank_of(c("cls")).alias("rank")).groupBy("x", "y", "z").agg(F.min("rank").alias("rank"))
    return g.filter(c("rank") < len(WINNERS)).select("x", "y", "z", class_of_rank(c("rank")).cast("long").alias("cls"))


def chunk_windows(voxels: DataFrame, side: int = 32, pad: int = 1) -> DataFrame:
    """(level, cx, cz, lx, lz, y, cls): each chunk's cells with the ring of its neighbours' cells, so
    that a chunk is whole by itself. A cell is in one chunk, and in the ring of at most three others.
    Chunks whose own cells are all air are left out."""
    def spans(n: str) -> Column:
        at = F.floor(c(n) / side)
        r = F.pmod(c(n), F.lit(side))
        near = F.array(at, F.when(r < pad, at - 1), F.when(r >= side - pad, at + 1))
        return F.filter(near, lambda v: v.isNotNull())

    d = voxels.withColumn("cx", F.explode(spans("x"))).withColumn("cz", F.explode(spans("z")))
    d = d.select("level", "cx", "cz", (c("x") - c("cx") * side + pad).alias("lx"), (c("z") - c("cz") * side + pad).alias("lz"), "y", "cls")
    own = d.filter((c("lx") >= pad) & (c("lx") < side + pad) & (c("lz") >= pad) & (c("lz") < side + pad)).select("level", "cx", "cz").distinct()
    return d.join(own, ["level", "cx", "cz"], "left_semi")


def class_histogram(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cls, n) for all 13 classes, zeros filled in: counts are pivoted, not joined."""
    g = cells.groupBy(*keys).agg(*[F.count_if(c("cls") == i).alias(f"_{i}") for i in range(len(CLASS_NAMES))])
    pairs = F.array(*[F.struct(F.lit(i).cast("long").alias("cls"), c(f"_{i}").alias("n")) for i in range(len(CLASS_NAMES))])
    return g.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.cls", "p.n")


def column_surfaces(voxels: DataFrame) -> DataFrame:
    """(x, z, ground, top, top_class): above the highest terrain cell, and above the highest of all."""
    return voxels.groupBy("x", "z").agg(F.coalesce(F.max(F.when(c("cls").isin(TERRAIN), c("y") + 1)), F.lit(0)).alias("ground"), (F.max("y") + 1).alias("top"), F.max_by("cls", "y").alias("top_class"))


# --- faces ------------------------------------------------------------------------------------------------

#: Directions (name, dx, dy, dz) of drawn faces: never the floor.
FACES = [("east", 1, 0, 0), ("west", -1, 0, 0), ("top", 0, 1, 0), ("south", 0, 0, 1), ("north", 0, 0, -1)]


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """(x, y, z, cls, face): faces whose neighbour is air. The neighbours are an equi-join of shifted
    coordinates, so any partitioning of the cells will do."""
    face = F.explode(F.array(*[F.struct(F.lit(n).alias("face"), F.lit(a).cast("long").alias("dx"), F.lit(b).cast("long").alias("dy"), F.lit(d).cast("long").alias("dz")) for n, a, b, d in FACES]))
    d = voxels.select("x", "y", "z", "cls", face.alias("f"))
    d = d.select("x", "y", "z", "cls", "f.face", (c("x") + c("f.dx")).alias("ax"), (c("y") + c("f.dy")).alias("ay"), (c("z") + c("f.dz")).alias("az"))
    other = voxels.select(c("x").alias("ax"), c("y").alias("ay"), c("z").alias("az"))
    return d.join(other, ["ax", "ay", "az"], "left_anti").select("x", "y", "z", "cls", "face")


def ambient(side1: Column, side2: Column, corner: Column) -> Column:
    """1 clear .. 0 enclosed, of a corner's three neighbours (1 solid, 0 air)."""
    return F.when((side1 == 1) & (side2 == 1), 0.0).otherwise((3 - (side1 + side2 + corner)) / 3.0)


def top_corner_ao(voxels: DataFrame) -> DataFrame:
    """(x, y, z, a0..a3, flipped): occlusion at the corners of top faces, and whether the quad is split
    along its other diagonal. One join with the cells above around, pivoted into eight flags."""
    tops = exposed_faces(voxels).filter("face = 'top'")
    around = F.explode(F.filter(offsets_square(1), lambda o: (o["dx"] != 0) | (o["dz"] != 0)))
    n = voxels.select("x", "y", "z", around.alias("o")).select((c("x") - c("o.dx")).alias("x"), (c("y") - 1).alias("y"), (c("z") - c("o.dz")).alias("z"), "o")
    flag = lambda dx, dz: F.max(F.when((c("o.dx") == dx) & (c("o.dz") == dz), 1).otherwise(0)).alias(f"s_{dx + 1}{dz + 1}")
    places = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    g = n.groupBy("x", "y", "z").agg(*[flag(i, j) for i, j in places])
    d = tops.join(g, ["x", "y", "z"], "left")
    s = lambda dx, dz: F.coalesce(c(f"s_{dx + 1}{dz + 1}"), F.lit(0))
    corners = [(-1, 1), (1, 1), (1, -1), (-1, -1)]
    ao = [ambient(s(dx, 0), s(0, dz), s(dx, dz)).alias(f"a{k}") for k, (dx, dz) in enumerate(corners)]
    d = d.select("x", "y", "z", "cls", *ao)
    return d.withColumn("flipped", c("a0") + c("a2") > c("a1") + c("a3"))


def outline_flags(voxels: DataFrame) -> DataFrame:
    """(x, y, z, cls, lines): sides of top faces that do not go on flat: another class, a step, an edge."""
    tops = exposed_faces(voxels).filter("face = 'top'").select("x", "y", "z", "cls")
    steps = [("south", 0, 1), ("east", 1, 0), ("north", 0, -1), ("west", -1, 0)]
    o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dz")) for _, i, j in steps]))
    flat = tops.select((c("x")).alias("x"), "y", "z", "cls", o.alias("o")).select((c("x") + c("o.dx")).alias("x"), "y", (c("z") + c("o.dz")).alias("z"), "cls")
    n = flat.groupBy("x", "y", "z", "cls").agg(F.count(F.lit(1)).alias("flat"))
    return tops.join(n, ["x", "y", "z", "cls"], "left").select("x", "y", "z", "cls", (4 - F.coalesce("flat", F.lit(0))).alias("lines"))


def lamp_tips(voxels: DataFrame) -> DataFrame:
    """(x, y, z): pole cells with air above."""
    return exposed_faces(voxels.filter(c("cls") == POLE).unionByName(voxels.filter(c("cls") != POLE))).filter((c("face") == "top") & (c("cls") == POLE)).select("x", "y", "z")


# --- merging sources ----------------------------------------------------------------------------------------


def merge_sources(base: DataFrame, surfaces: DataFrame, objects: DataFrame) -> DataFrame:
    """(x, y, z, cls) of three voxel sources on one grid. Where neither base nor ``surfaces`` builds, the
    base's highest ground takes the other's surface class; vegetation, then poles, of ``objects`` are
    moved by the difference of the grounds, into air that no building of the base stands over."""
    flat = [GROUND, ROAD, SIDEWALK, WATER]

    def columns(v: DataFrame, name: str) -> DataFrame:
        own = c("cls").isin(flat)
        return v.groupBy("x", "z").agg(F.coalesce(F.max(F.when(own, c("y"))), F.lit(-1)).alias(f"{name}_top"), F.max_by("cls", F.when(own, c("y"))).alias(f"{name}_cls"), F.bool_or(c("cls").isin(BUILDING, ROOF)).alias(f"{name}_built"))

    b, s, o = columns(base, "b"), columns(surfaces, "s"), columns(objects, "o").select("x", "z", "o_top")
    j = b.join(s, ["x", "z"], "left")
    paint = j.filter(~c("b_built") & ~F.coalesce("s_built", F.lit(False)) & c("s_cls").isin(ROAD, SIDEWALK, WATER) & (c("b_top") >= 0)).select("x", "z", c("b_top").alias("y"), c("s_cls").alias("cls"), F.lit(1).alias("prio"))
    things = objects.filter(c("cls").isin(VEG, POLE)).join(o, ["x", "z"]).join(b.filter(~c("b_built")), ["x", "z"])
    moved = things.select("x", "z", (c("y") + c("b_top") - c("o_top")).alias("y"), "cls", F.lit(-1).alias("prio")).filter("y >= 0")
    # into air only: a base cell outranks; vegetation goes before poles
    rank = F.struct("prio", F.when(c("cls") == VEG, 1).otherwise(0))
    cells = base.select("x", "z", "y", "cls", F.lit(0).alias("prio")).unionByName(paint).unionByName(moved)
    return cells.groupBy("x", "y", "z").agg(F.max_by("cls", rank).alias("cls"))


def tree_cells(trees: DataFrame) -> DataFrame:
    """(x, y, z): a trunk of three cells and a round canopy of radius two above, for (x, z, base)."""
    trunk = [(0, k, 0) for k in range(3)]
    crown = [(i, 3 + k, j) for k in range(-2, 3) for j in range(-2, 3) for i in range(-2, 3) if i * i + j * j + k * k <= 5]
    o = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(k).cast("long").alias("k"), F.lit(j).cast("long").alias("j")) for i, k, j in dict.fromkeys(trunk + crown)]))
    return trees.select("x", "z", "base", o.alias("o")).select((c("x") + c("o.i")).alias("x"), (c("base") + c("o.k")).alias("y"), (c("z") + c("o.j")).alias("z")).filter("y >= 0").distinct()


def sampled_triangles(tris: DataFrame, key: str, step: float) -> DataFrame:
    """(key, x, y, z): points over triangles (ax..cz), no farther apart than ``step`` along the edges."""
    side = lambda p, q: F.sqrt(sum(((c(f"{p}{k}") - c(f"{q}{k}")) * (c(f"{p}{k}") - c(f"{q}{k}")) for k in "xyz"), F.lit(0.0)))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(side("a", "b"), side("a", "c"), side("b", "c")) / step)).cast("int")
    d = tris.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), c("n")))).withColumn("j", F.explode(F.sequence(F.lit(0), c("n") - c("i"))))
    at = lambda k: (c(f"a{k}") + c("i") / c("n") * (c(f"b{k}") - c(f"a{k}")) + c("j") / c("n") * (c(f"c{k}") - c(f"a{k}"))).alias(k)
    return d.select(key, at("x"), at("y"), at("z"))
