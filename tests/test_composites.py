"""Chains on made scenes."""

import math

from pyspark.sql import functions as F

from gridspan.operators import rivers
from gridspan.plans import composites as m

c = F.col


def cells(df):
    return {(r.x, r.y, r.z): r.cls for r in df.collect()}


def test_osm_scene(spark):
    ground = spark.createDataFrame([(x, z, 3 + (x > 3)) for x in range(8) for z in range(4)], "x long, z long, h_col long")
    strokes = spark.createDataFrame([("road", 1, 0, 0), ("water", 9, 0, 0), ("foot", 2, 1, 0), ("veg", 3, 5, 1)], "layer string, seq int, x long, z long")
    feet = spark.createDataFrame([(1, x, z) for x in (3, 4, 5) for z in (1, 2)] + [(2, 5, 1)], "id long, x long, z long")
    b = spark.createDataFrame([(1, 2.5), (2, 9.0)], "id long, height double")
    got = cells(m.osm_voxels(ground, m.osm_surface(strokes), feet, b))
    assert got[0, 2, 0] == 2 and got[1, 2, 0] == 3 and got[2, 2, 0] == 1  # the road paints over the water
    # the lowest ground under building 1 is 3, its height rounds to 2: the roof ends at 5, one above the ground at x > 3
    assert got[3, 3, 1] == 4 and got[3, 4, 1] == 5 and (3, 5, 1) not in got
    assert got[4, 4, 1] == 5 and got[5, 12, 1] == 5 and got[5, 4, 1] == 4  # the higher of two


def test_block_scene(spark):
    terrain = [(x, 1 if x < 4 else 2, z, "stone") for x in range(8) for z in range(3)] + [(0, 2, 0, "oak_log")]
    objects = [(x, 1 if x < 4 else 2, z, "gray_concrete" if z == 2 else "grass_block") for x in range(8) for z in range(3)]
    objects += [(1, y, 0, "bricks") for y in (2, 3, 4)] + [(6, y, 0, "stone_brick_wall") for y in (3, 4)] + [(3, 2, 0, "oak_fence"), (0, 2, 0, "oak_log"), (2, 2, 1, "poppy")]
    d = lambda rows: spark.createDataFrame(rows, "x long, y long, z long, name string")
    got = cells(m.block_voxels(d(objects), d(terrain)))  # y 0 is one below the lowest ground: y = block - 0
    assert got[0, 1, 2] == 3 and got[0, 1, 0] == 1 and got[0, 0, 0] == 1
    assert [got[1, y, 0] for y in (2, 3, 4)] == [4, 4, 5]
    assert got[6, 3, 0] == 7 and got[3, 2, 0] == 12 and got[0, 2, 0] == 6 and (2, 2, 1) not in got


def test_lidar_scene(spark):
    pts = []
    for x in range(20):
        for z in range(20):
            pts += [(x + 0.3, z + 0.4, 5.0, 2, 1, 1, 90, 90, 90), (x + 0.6, z + 0.6, 5.1, 2, 1, 1, 90, 90, 90)]
    for x in range(4, 8):
        for z in range(4, 8):
            pts += [(x + 0.1 * i, z + 0.5, 13.0, 1, 1, 1, 120, 100, 100) for i in range(4)]  # a roof eight metres up
    for x in range(13, 16):
        for z in range(13, 16):
            pts += [(x + 0.1 * i, z + 0.5, 7.0 + i, 1, 1, 2, 50, 120, 40) for i in range(4)]  # a crown
    pts += [(10.5, 2.5, 6.2, 1, 1, 1, 100, 100, 100)]  # a thing on the road
    cloud = spark.createDataFrame(pts, "x double, y double, z double, c int, rn int, nr int, r int, g int, b int")
    masks = spark.createDataFrame([(x, z, 4 <= x < 8 and 4 <= z < 8, x == 10, False, x == 19) for x in range(20) for z in range(20)], "x long, z long, building boolean, road boolean, sidewalk boolean, water boolean")
    got = cells(m.lidar_voxels(cloud, masks))
    assert got[0, 0, 0] == 1 and got[10, 0, 0] == 2 and got[19, 0, 3] == 8
    assert got[5, 8, 5] == 5 and all(got[5, y, 5] == 4 for y in range(1, 8)) and (5, 9, 5) not in got
    assert got[14, 5, 14] == 6 and got[14, 1, 14] == 6  # the trunk reaches the ground under the top
    assert got[10, 1, 2] == 11


def test_street_scene(spark):
    pts = [(x + 0.5, z + 0.5, 1.0, 2, 90, 90, 90) for x in range(24) for z in range(24)]
    pts += [(5.1, 5.1, 1.3 + 0.05 * i, 1, 100, 100, 100) for i in range(160)]  # a pole of eight metres
    for x in range(12, 16):
        for z in range(12, 16):
            for y in range(5):
                pts += [(x + 0.02 * i, z + 0.02 * i, 1.5 + y, 1, 150, 100, 100) for i in range(45)]
    pts += [(20.1 + 0.05 * i, 3.2, 3.5, 1, 40, 120, 30) for i in range(8)]
    cloud = spark.createDataFrame([(*p[:4], 1, 1, *p[4:]) for p in pts], "x double, y double, z double, c int, rn int, nr int, r int, g int, b int")
    masks = spark.createDataFrame([(x, z, False, x == 2, False, False) for x in range(24) for z in range(24)], "x long, z long, building boolean, road boolean, sidewalk boolean, water boolean")
    got = cells(m.street_voxels(cloud, masks))
    assert got[2, 0, 5] == 2 and got[0, 0, 0] == 1
    assert [got.get((5, y, 5)) for y in (1, 4, 8)] == [7, 7, 7]
    assert got[13, 2, 13] == 4 and got[20, 3, 3] == 6


def test_detail_mask_and_archive(spark, tmp_path):
    rows = [(x, z, 1, 1.0 + (x + z) % 3, None, 9.0 if x % 9 < 4 else None, None, 2 if z % 6 == 0 else 0, 1, True) for x in range(130) for z in range(70)]
    tiles = spark.createDataFrame(rows, "x long, z long, tile int, h double, w double, bh double, deck double, rc int, rc_lod int, cover boolean")
    spans = spark.createDataFrame([(3, 3, 20, 22, 7)], "x long, z long, y0 long, y1 long, cls long")
    detail = spark.createDataFrame([(0, 0)], "bx long, bz long")
    d = m.build_map(tiles, spans, str(tmp_path / "m"), levels=3, detail=detail)
    by = {r.level: r.n for r in d.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by[0] == 4 and by[1] == 3 * 2 and by[2] == 2 * 1  # only one level-1 chunk keeps its children
    opened = m.open_chunks(spark, str(tmp_path / "m"))
    assert {r.cls for r in opened.filter("level = 0 AND lx = 4 AND lz = 4 AND cx = 0 AND cz = 0 AND y >= 20").collect()} == {7}


def test_rivers_to_pixels(spark):
    pts = [("r", 1, i, 179.0 + 0.1 * i if i < 10 else -180.0 + 0.1 * (i - 10), 10.0 + 0.05 * i) for i in range(20)]
    pts += [("r", 2, i, -178.5 + 0.1 * i, 11.2) for i in range(5)]
    p = spark.createDataFrame(pts, "river string, line long, seq int, lon double, lat double")
    got = rivers.pixels(p)
    page = got["pages"].first()
    assert page.east > 180 > page.west and page.w <= 510
    ink = {(r.x, r.z) for r in got["ink"].collect()}
    # one connected drawing: the gap between the two lines is bridged
    todo, seen = [next(iter(ink))], set()
    while todo:
        x, z = todo.pop()
        if (x, z) in ink and (x, z) not in seen:
            seen.add((x, z))
            todo += [(x + i, z + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert seen == ink


def test_flight_demand_covers_the_end(spark):
    directory = spark.createDataFrame([(lv, x, z, 2) for lv in range(7) for x in range(64 >> lv if lv < 6 else 1) for z in range(64 >> lv if lv < 6 else 1)], "level long, cx long, cz long, height long")
    f = spark.createDataFrame([(1, 300.0, 300.0, 1.0, 1700.0, 1500.0, 1.0)], "flight long, x0 double, z0 double, zoom0 double, x1 double, z1 double, zoom1 double")
    got = {(r.level, r.cx, r.cz): r.score for r in m.flight_demand(f, directory).collect()}
    finest = min(k[0] for k in got)
    assert any(k == (finest, 1700 // (32 << finest), 1500 // (32 << finest)) for k in got)
    for (lv, x, z), s in got.items():
        if lv < 6:
            assert got[lv + 1, x >> 1, z >> 1] <= s  # ancestors come no later
    assert math.isclose(min(got.values()), 0.0)
