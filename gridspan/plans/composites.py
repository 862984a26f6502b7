"""Chains of operators: from sources to voxels, from voxels to an archive, from a flight to its demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.functions import curves
from gridspan.operators import codec, graph, grid, osm, points, view
from gridspan.operators.grid import BUILDING, FENCE, FURNITURE, GROUND, POLE, ROAD, ROOF, SIDEWALK, VEG, WATER
from gridspan.sources.blocks import block_kind, surface_class

c = F.col


def osm_surface(strokes: DataFrame) -> DataFrame:
    """(x, z, cls) of strokes (layer, seq, x, z): layers from the weakest to the strongest."""
    order = ["veg", "sparse", "water", "foot", "sidewalk", "rail", "road", "bridge"]
    cls = {"veg": VEG, "sparse": VEG, "water": WATER, "foot": SIDEWALK, "sidewalk": SIDEWALK, "rail": 9, "road": ROAD, "bridge": 10}
    prio, code = None, None
    for i, name in enumerate(order):
        prio = F.when(c("layer") == name, i) if prio is None else prio.when(c("layer") == name, i)
        code = F.when(c("layer") == name, cls[name]) if code is None else code.when(c("layer") == name, cls[name])
    return grid.last_painted(strokes.select("x", "z", "seq", prio.alias("prio"), code.alias("cls")).filter("prio IS NOT NULL"), ["prio", "seq"])


def osm_voxels(ground: DataFrame, surface: DataFrame, footprints: DataFrame, buildings: DataFrame, ny: int = 100) -> DataFrame:
    """(x, y, z, cls): columns up to the ground (x, z, h_col), the surface on top, and buildings (id,
    height in metres) over their footprints (id, x, z): the roof is the lowest ground under the footprint
    plus the height, at least two cells, the highest of overlapping ones, within the grid."""
    tall = footprints.join(ground, ["x", "z"]).groupBy("id").agg(F.min("h_col").alias("low")).join(buildings, "id")
    tall = tall.select("id", (c("low") + F.greatest(F.lit(2), F.rint("height")).cast("long")).alias("roof"))
    roof = footprints.join(tall, "id").groupBy("x", "z").agg(F.max("roof").alias("roof"))
    d = ground.join(surface, ["x", "z"], "left").join(roof, ["x", "z"], "left").withColumn("roof", F.when(c("roof").isNotNull(), F.least(F.greatest("roof", c("h_col") + 1), F.lit(ny))))
    built = c("roof").isNotNull()
    cells = d.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("h_col", F.coalesce("roof", "h_col")).cast("long") - 1)))
    cls = F.when(c("y") >= c("h_col"), F.when(c("y") == c("roof") - 1, ROOF).otherwise(BUILDING)).when((c("y") == c("h_col") - 1) & ~built & c("cls").isNotNull(), c("cls")).otherwise(GROUND)
    return cells.select("x", "y", "z", cls.cast("long").alias("cls"))


def lidar_voxels(cloud: DataFrame, masks: DataFrame, ny: int = 100) -> DataFrame:
    """(x, y, z, cls) of an aerial cloud. ``masks``: (x, z, building, road, sidewalk, water) of cells.

    Ground is the median of ground points, filled from the nearest; columns of green or scattered points
    are vegetation; footprints are raised to the 80th percentile of their points; what is left low is
    furniture on streets and walls elsewhere.
    """
    targets = masks.select("x", "z")
    median = points.ground_median(cloud).select(c("ix").alias("x"), c("iz").alias("z"), "h")
    dem = grid.nearest_fill(median, targets).select("x", "z", c("h").alias("v"))
    dem = grid.neighbourhood(dem, 1, F.median("w")).select("x", "z", c("out").alias("h"))
    base = dem.agg(F.floor(F.min("h")).alias("b")).first()["b"] or 0
    surf = dem.select("x", "z", F.floor(c("h") - base).cast("long").alias("surf"), "h")
    ev = points.voxel_evidence(cloud, surf.select(c("x").alias("ix"), c("z").alias("iz"), "h"), 0.7)
    walls = masks.filter("building").select("x", "z")
    wall = grid.within(targets, walls, 2.0).select(c("x").alias("ix"), c("z").alias("iz"), F.sqrt("d2").alias("distance"))
    far = wall.withColumn("distance", F.when(c("distance") < 2, c("distance")).otherwise(F.lit(2.0)))
    veg = points.column_vegetation(ev, far).select(c("ix").alias("x"), c("iz").alias("z"), "veg")
    roofs = points.roof_heights(cloud, surf.select(c("x").alias("ix"), c("z").alias("iz"), "h")).select(c("ix").alias("x"), c("iz").alias("z"), "roof")
    known = roofs.join(walls, ["x", "z"]).filter("roof IS NOT NULL")
    filled = grid.nearest_fill(known.select("x", "z", c("roof").alias("h")), walls).select("x", "z", c("h").alias("v")) if not known.isEmpty() else known.select("x", "z", c("roof").alias("v"))
    rise = grid.neighbourhood(filled, 1, F.median("w")).filter("out > 1.5").select("x", "z", F.rint("out").cast("long").alias("rise"))
    m = masks.join(surf, ["x", "z"]).join(rise, ["x", "z"], "left").join(veg, ["x", "z"], "left")
    top_cls = F.when(c("water"), WATER).when(c("road") & ~c("building"), ROAD).when(c("sidewalk") & ~c("building"), SIDEWALK).otherwise(GROUND)
    solid = m.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), (c("surf") + F.coalesce("rise", F.lit(0))).cast("long"))))
    solid = solid.select("x", "y", "z", F.when(c("y") < c("surf"), GROUND).when(c("y") == c("surf"), top_cls).when(c("y") == c("surf") + c("rise"), ROOF).otherwise(BUILDING).cast("long").alias("cls"))
    loose = ev.select(c("ix").alias("x"), c("iz").alias("z"), (c("k") - base).alias("y")).join(m.filter("NOT building").select("x", "z", "surf", "veg", "road", "sidewalk"), ["x", "z"]).filter("y > surf")
    crown = loose.filter("veg").groupBy("x", "z").agg(F.max("y").alias("top"))
    trees = points.canopy_fill(crown, surf.select("x", "z", "surf")).withColumn("cls", F.lit(VEG).cast("long"))
    trees = trees.unionByName(loose.filter("veg").select("x", "z", "y", F.lit(VEG).cast("long").alias("cls")))
    low = loose.filter((~F.coalesce("veg", F.lit(False))) & (c("y") <= c("surf") + 3)).select("x", "z", "y", F.when(c("road") | c("sidewalk"), FURNITURE).otherwise(FENCE).cast("long").alias("cls"))
    ranked = solid.withColumn("p", F.lit(2)).unionByName(trees.withColumn("p", F.lit(1))).unionByName(low.withColumn("p", F.lit(0)))
    return ranked.filter((c("y") >= 0) & (c("y") < ny)).groupBy("x", "y", "z").agg(F.max_by("cls", "p").alias("cls"))


def block_voxels(objects: DataFrame, terrain: DataFrame, ny: int = 100) -> DataFrame:
    """(x, y, z, cls) of block worlds (x, y, z, name): ``terrain`` gives the ground (its highest block that
    is no tree or plant), ``objects`` what stands on it. A lamp part with nothing in the eight cells
    around it is a pole; the highest wall of a column is its roof."""
    ground = terrain.filter(~block_kind(c("name")).isin("air", "veg")).groupBy("x", "z").agg(F.max("y").alias("g"))
    base = ground.agg(F.min("g").alias("b")).first()["b"]
    base = (base or 0) - 1
    o = objects.join(ground, ["x", "z"]).withColumn("kind", block_kind(c("name")))
    surf = o.filter("y = g").select("x", "z", surface_class(c("name")).alias("cls"))
    above = o.filter((c("y") > c("g")) & (c("kind") != "air")).select("x", "y", "z", "kind")
    near = above.select("y", F.explode(F.filter(grid.offsets_square(1), lambda s: (s["dx"] != 0) | (s["dz"] != 0))).alias("s"), "x", "z").select("y", (c("x") + c("s.dx")).alias("x"), (c("z") + c("s.dz")).alias("z")).distinct()
    lamps = above.filter("kind = 'lamp'").join(near, ["x", "y", "z"], "left_anti").select("x", "y", "z", F.lit(POLE).alias("lamp"))
    top = above.filter("kind = 'solid'").groupBy("x", "z").agg(F.max("y").alias("roof"))
    a = above.join(lamps, ["x", "y", "z"], "left").join(top, ["x", "z"], "left")
    cls = F.coalesce("lamp", F.when((c("kind") == "solid") & (c("y") == c("roof")), ROOF).when(c("kind") == "solid", BUILDING).when(c("kind") == "veg", VEG).otherwise(FENCE))
    things = a.select("x", (c("y") - base).alias("y"), "z", cls.cast("long").alias("cls"))
    floor = ground.join(surf, ["x", "z"], "left").withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), (c("g") - base).cast("long"))))
    floor = floor.select("x", "y", "z", F.when(c("y") == c("g") - base, F.coalesce("cls", F.lit(GROUND))).otherwise(GROUND).cast("long").alias("cls"))
    return floor.unionByName(things).filter(c("y") < ny)


def street_voxels(cloud: DataFrame, masks: DataFrame, ny: int = 100) -> DataFrame:
    """(x, y, z, cls) of a street-level scan: ground near seen ground, poles, foliage by colour and
    scatter, solid components as buildings where they are large and tall, else street furniture."""
    targets = masks.select("x", "z")
    median = points.ground_median(cloud).select(c("ix").alias("x"), c("iz").alias("z"), "h")
    dem = grid.nearest_fill(median, targets)
    base = dem.agg(F.floor(F.min("h")).alias("b")).first()["b"] or 0
    surf = dem.select("x", "z", F.floor(c("h") - base).cast("long").alias("surf"), "h", "d2")
    flat = surf.select(c("x").alias("ix"), c("z").alias("iz"), "h")
    bins = points.pole_bins(cloud, flat)
    labels = graph.cell_components(bins.select(c("fu").alias("x"), c("fv").alias("z")), True)
    poles = points.poles(bins, labels).select(F.floor("u").cast("long").alias("x"), F.floor("v").cast("long").alias("z"), "top").groupBy("x", "z").agg(F.max("top").alias("top"))
    halo = poles.select("x", "z", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])).alias("o")).select((c("x") + c("o.i")).alias("x"), (c("z") + c("o.j")).alias("z")).distinct()
    up = points.cell(cloud).join(flat, ["ix", "iz"]).withColumn("up", c("z") - c("h")).filter((c("up") > 0.35) & (c("up") < ny - 6))
    v = up.groupBy(c("ix").alias("x"), c("iz").alias("zz"), F.floor("up").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(points.green(1.06, 1.10, 40)).alias("green")).withColumnRenamed("zz", "z")
    v = v.join(halo, ["x", "z"], "left_anti").join(surf.select("x", "z", "surf"), ["x", "z"]).withColumn("y", c("surf") + c("k") + 1)
    veg = v.filter((c("n") >= 6) & (c("green") / c("n") >= 0.35))
    solid = v.join(veg.select("x", "y", "z"), ["x", "y", "z"], "left_anti").filter("n >= 40")
    comp = graph.cell_components(solid.select("x", "z").distinct(), True)
    size = solid.join(comp, ["x", "z"]).groupBy("label").agg(F.count(F.lit(1)).alias("cells"), (F.max("y") - F.min("y") + 1).alias("tall"))
    solid = solid.join(comp, ["x", "z"]).join(size, "label").join(masks.select("x", "z", "road", "sidewalk"), ["x", "z"], "left")
    street = F.coalesce(c("road") | c("sidewalk"), F.lit(False))
    things = solid.select("x", "y", "z", F.when((c("cells") >= 60) & (c("tall") >= 4), BUILDING).when(street, FURNITURE).otherwise(FENCE).cast("long").alias("cls"), F.lit(1).alias("p"))
    things = things.unionByName(veg.select("x", "y", "z", F.lit(VEG).cast("long").alias("cls"), F.lit(2).alias("p")))
    posts = poles.join(surf, ["x", "z"]).select("x", "z", F.explode(F.sequence(c("surf") + 1, c("surf") + F.rint("top").cast("long"))).alias("y")).select("x", "y", "z", F.lit(POLE).cast("long").alias("cls"), F.lit(3).alias("p"))
    near = surf.filter("d2 <= 16").join(masks.select("x", "z", "road", "sidewalk"), ["x", "z"])
    top_cls = F.when(c("road"), ROAD).when(c("sidewalk"), SIDEWALK).otherwise(GROUND)
    floor = near.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), c("surf")))).select("x", "y", "z", F.when(c("y") == c("surf"), top_cls).otherwise(GROUND).cast("long").alias("cls"), F.lit(4).alias("p"))
    cells = floor.unionByName(posts).unionByName(things)
    return cells.filter(c("y") < ny).groupBy("x", "y", "z").agg(F.max_by("cls", "p").alias("cls"))


def build_map(tiles: DataFrame, spans: DataFrame, path: str, levels: int = 3, roof_step: int = 3, detail: DataFrame | None = None) -> DataFrame:
    """Tiles to an archive at ``path``; returns its directory. Merge, compose, pool, cut chunks, count
    symbols, train tables, code, order and write. ``detail``: (bx, bz) level-1 chunks that keep level 0."""
    layers = grid.merged_tiles(tiles).withColumn("known_h", c("h"))
    voxels = grid.composed(layers, spans, roof_step)
    windows = grid.chunk_windows(grid.pyramid(voxels, levels))
    if detail is not None:
        fine = windows.filter("level = 0").join(detail.select(c("bx").alias("px"), c("bz").alias("pz")).distinct(), (F.shiftright("cx", 1) == c("px")) & (F.shiftright("cz", 1) == c("pz")), "left_semi")
        windows = fine.unionByName(windows.filter("level > 0"))
    chunks = codec.chunk_columns(windows).checkpoint()  # read twice: to train, then to code
    table = codec.model_table(codec.pool_counts(codec.symbol_counts(chunks)))
    table.write.parquet(f"{path}/model")
    model = codec.read_model(chunks.sparkSession.read.parquet(f"{path}/model"))
    return codec.write_archive(codec.encoded(chunks, model), path)


def open_chunks(spark, path: str) -> DataFrame:
    """(level, cx, cz, lx, lz, y, cls) of an archive's chunks: blobs found by the directory, decoded."""
    model = codec.read_model(spark.read.parquet(f"{path}/model"))
    blobs = spark.read.parquet(f"{path}/shards").select("offset", "blob")
    return codec.decoded(spark.read.parquet(f"{path}/directory").join(blobs, "offset").select("level", "cx", "cz", "blob"), model)


def flight_demand(flights: DataFrame, directory: DataFrame, samples: int = 40, aspect: float = 1.5, height_px: float = 900.0, detail_px: float = 2.0, pad: float = 24.0) -> DataFrame:
    """(flight, level, cx, cz, score): all that a camera's path (flight, x0, z0, zoom0, x1, z1, zoom1) will
    want, by urgency: samples along the path, the chunks of each view, and their ancestors."""
    k = 2 * curves.HALF_HEIGHT * aspect
    f = flights.withColumn("w0", F.lit(k) / c("zoom0")).withColumn("w1", F.lit(k) / c("zoom1")).withColumn("reach", F.greatest(F.abs(c("x1") - c("x0")), F.abs(c("z1") - c("z0")) * aspect) * curves.MARGIN)
    f = f.withColumn("plan", curves.flight(c("w0"), c("w1"), c("reach"))).withColumn("ms", curves.flight_ms(c("plan.length")))
    s = f.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples)))).withColumn("u", c("i") / samples)
    s = s.withColumn("at", curves.flight_at(c("plan"), c("w0"), c("w1"), c("reach"), c("plan.length") * curves.smoothstep(c("u"))))
    x, z, half = c("x0") + (c("x1") - c("x0")) * c("at.frac"), c("z0") + (c("z1") - c("z0")) * c("at.frac"), c("at.width") / 2
    s = s.select("flight", "i", (c("u") * c("ms")).alias("t"), curves.pixels_per_metre(F.lit(height_px), F.lit(k) / c("at.width")).alias("ppm"), (detail_px * curves.detail_scale(c("u"))).alias("detail"), (x - half).alias("vx0"), (x + half).alias("vx1"), (z - half / aspect).alias("vz0"), (z + half / aspect).alias("vz1"))
    p = lambda a, b, d: F.struct(F.lit(a).alias("a"), F.lit(0.0).alias("b"), F.lit(b).alias("c"), d.alias("d"))
    planes = F.array(p(1.0, 0.0, -c("vx0")), p(-1.0, 0.0, c("vx1")), p(0.0, 1.0, -c("vz0")), p(0.0, -1.0, c("vz1")))
    v = s.select(F.struct("flight", "i", "t").alias("view"), "ppm", "detail", F.lit(pad).alias("pad"), planes.alias("planes"), c("vx0").alias("x0"), c("vx1").alias("x1"), c("vz0").alias("z0"), c("vz1").alias("z1"))
    wanted = view.select_chunks(v, directory, spread="view.flight").select(c("view.flight").alias("flight"), c("view.t").alias("t"), "level", "cx", "cz")
    return view.demand(wanted, ["flight"])


def multipolygon_cells(members: DataFrame) -> DataFrame:
    """(id, x, z): cells of relations' outer rings less those of their inner ones. ``members``: (id,
    role, ring)."""
    keyed = members.withColumn("m", F.struct("id", F.when(c("role") == "inner", "inner").otherwise("outer").alias("role"), F.monotonically_increasing_id().alias("n")))
    cells = grid.polygon_cells(keyed.select("m", "ring"), "m", "ring")
    g = cells.groupBy(c("m.id").alias("id"), "x", "z").agg(F.bool_or(c("m.role") == "inner").alias("hole"), F.bool_or(c("m.role") == "outer").alias("in"))
    return g.filter("in AND NOT hole").select("id", "x", "z")


def river_lines(relations: DataFrame, members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(river, line, seq, lon, lat): centre lines of relations (river, root), sub-relations walked."""
    walked = osm.walk_relations(relations.select("root"), members)
    use = osm.member_ways(walked, members, ways)
    lines = osm.way_lines(ways.join(use.select(c("way").alias("id")).distinct(), "id", "left_semi"), nodes)
    d = relations.join(use, "root").join(lines, c("way") == c("id")).select("river", c("way").alias("line"), F.posexplode("line").alias("seq", "p"))
    return d.select("river", "line", "seq", F.round("p.lon", 5).alias("lon"), F.round("p.lat", 5).alias("lat")).distinct()
