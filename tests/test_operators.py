"""Edge rules on small inputs, and order-dependent operators against plain loops."""

import math
import random
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspan.functions import bits, coords, curves, text
from gridspan.operators import codec, graph, grid, osm, points, rivers, symbols, view
from gridspan.plans import catalog

c = F.col


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_rounding_and_overflow(spark):
    assert [one(spark, bits.unzigzag(bits.zigzag(F.lit(v)))) for v in (-5, -1, 0, 3)] == [-5, -1, 0, 3]
    assert [tuple(one(spark, bits.value_symbol(F.lit(v)))) for v in (11, 12, 4095, 4096)] == [(11, 0, 0), (12, 3, 4), (20, 11, 2047), (21, 12, 0)]
    assert one(spark, text.byte_of(F.lit(0.5))) == 128
    assert one(spark, bits.floor_div(F.lit(-7), 2)) == -4
    assert 0 <= one(spark, bits.lattice_hash(F.lit(-10**6), F.lit(123456), 9)) < 1
    x, z = 5461, 10922
    m = one(spark, bits.morton(F.lit(x), F.lit(z)))
    assert m == sum(((x >> b) & 1) << 2 * b | ((z >> b) & 1) << 2 * b + 1 for b in range(14))


def test_lenient_numbers(spark):
    got = [one(spark, text.lenient_number(F.lit(s))) for s in ("12", "12.5 m", "5,5", "x", None)]
    assert got == [12.0, 12.5, 5.5, None, None]
    assert one(spark, text.truthy(F.lit(0.0))) is None
    assert one(spark, text.leading_integer(F.lit("6,650 (est.)"))) == 6650


def test_transverse_mercator_origin(spark):
    lat, lon = coords.ZONE_IX
    p = one(spark, coords.to_plane(F.lit(lat), F.lit(lon)))
    assert abs(p["e"]) < 1e-6 and abs(p["n"]) < 1e-6
    q = one(spark, coords.to_plane(F.lit(lat + 1.0), F.lit(lon)))
    assert 110_000 < q["n"] < 112_000


def test_flight_ends(spark):
    w0, w1, u = F.lit(100.0), F.lit(300.0), F.lit(5000.0)
    p = curves.flight(w0, w1, u)
    a = one(spark, curves.flight_at(p, w0, w1, u, F.lit(0.0)))
    b = one(spark, curves.flight_at(p, w0, w1, u, p["length"]))
    assert a["frac"] == pytest.approx(0, abs=1e-9) and a["width"] == pytest.approx(100)
    assert b["frac"] == pytest.approx(1, abs=1e-9) and b["width"] == pytest.approx(300)


def test_first_per_key_keeps_null_ids(spark):
    d = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 1)], "seq int, gid string, ward int")
    assert sorted(r.seq for r in osm.first_per_key(d, ["gid"], ["ward", "seq"], keep_nulls=True).collect()) == [2, 3, 4]


def test_alias_chains_are_followed_to_the_end(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("side", "n39"), ("x", "y"), ("gone", None), ("p", "q"), ("q", "p")]
    aliases = spark.createDataFrame(links, "source string, target string")
    names = spark.createDataFrame([(n,) for n in ["n0", "n7", "n39", "n40", "side", "x", "gone", "other"]], "name string")
    got = {r.name: r.final for r in osm.resolve_aliases(names, aliases).collect()}
    assert got == {**dict.fromkeys(["n0", "n7", "n39", "n40", "side"], "n40"), "x": "y", "gone": "gone", "other": "other"}
    none = osm.resolve_aliases(names, aliases.limit(0)).collect()
    assert len(none) == 8 and all(r.name == r.final for r in none)
    with pytest.raises(RuntimeError, match="ring"):
        osm.resolve_aliases(spark.createDataFrame([("p",)], "name string"), aliases)
    rows = spark.createDataFrame([(1, "R", 900, ["n0"])], "row long, name string, length_km long, titles array<string>")
    ids = spark.createDataFrame([("n40", "Q1")], "title string, qid string")
    assert rivers.with_ids(rows, aliases, ids).first()["qids"] == ["Q1"]


def test_polygon_cells_of_concave_rings(spark):
    rng = random.Random(3)
    rings = []
    for i in range(30):
        n = rng.randint(3, 8)
        pts = sorted(((math.cos(a) * rng.uniform(2, 9) + 20, math.sin(a) * rng.uniform(2, 9) + 20) for a in (rng.uniform(0, 6.28) for _ in range(n))), key=lambda p: math.atan2(p[1] - 20, p[0] - 20))
        rings.append((i, [*pts, pts[0]]))
    d = spark.createDataFrame(rings, "id int, ring array<struct<x:double,z:double>>")
    got = {tuple(r) for r in grid.polygon_cells(d, "id", "ring").collect()}
    want = set()
    for i, ring in rings:
        for x in range(5, 36):
            for z in range(5, 36):
                px, pz, odd = x + 0.5, z + 0.5, False
                for (x0, z0), (x1, z1) in zip(ring, ring[1:], strict=False):
                    if (z0 <= pz) != (z1 <= pz) and px >= x0 + (pz - z0) * (x1 - x0) / (z1 - z0):
                        odd = not odd
                if odd:
                    want.add((i, x, z))
    assert got == want


def test_plane_fit_against_solver(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 10, (40, 2))
    z = 2 * xy[:, 0] - 3 * xy[:, 1] + 5 + rng.normal(0, 0.1, 40)
    rows = [(1, float(a), float(b), float(h)) for (a, b), h in zip(xy, z, strict=True)] + [(2, float(i), float(i), 1.0) for i in range(4)]
    got = {r.id: r for r in grid.plane_fit(spark.createDataFrame(rows, "id int, x double, y double, z double"), "id").collect()}
    want = np.linalg.lstsq(np.column_stack([xy, np.ones(40)]), z, rcond=None)[0]
    assert [got[1].a, got[1].b, got[1].c0] == pytest.approx(list(want))
    assert got[2].a is None  # points in a line have no plane


def test_smallest_eigenvalue(spark):
    rng = np.random.default_rng(1)
    for _ in range(5):
        m = np.cov(rng.normal(size=(3, 20)) * [[1], [0.2], [3]])
        got = one(spark, points.smallest_eigenvalue(*(F.lit(float(v)) for v in (m[0, 0], m[1, 1], m[2, 2], m[0, 1], m[0, 2], m[1, 2]))))
        assert got == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-9)


def test_nearest_fill_reaches_far_cells(spark):
    known = spark.createDataFrame([(0, 0, 1.0), (300, 10, 2.0)], "x long, z long, h double")
    t = spark.createDataFrame([(x, z) for x in range(0, 320, 20) for z in (0, 50)], "x long, z long")
    for r in grid.nearest_fill(known, t).collect():
        a, b = r.x**2 + r.z**2, (r.x - 300) ** 2 + (r.z - 10) ** 2
        assert r.d2 == min(a, b) and r.h == (1.0 if a <= b else 2.0)


def test_nearest_fill_against_all_pairs(spark):
    rng = random.Random(7)
    known = [(x, z, float(i)) for i, (x, z) in enumerate({(rng.randint(-40, 40), rng.randint(-900, 40)) for _ in range(60)})]
    cells = [(x, z) for x in range(-20, 30, 3) for z in range(-30, 30, 2)]
    got = {(r.x, r.z): (r.d2, r.h) for r in grid.nearest_fill(spark.createDataFrame(known, "x long, z long, h double"), spark.createDataFrame(cells + cells[:5], "x long, z long")).collect()}
    want = {(x, z): min(((x - a) ** 2 + (z - b) ** 2, b, a, h) for a, b, h in known) for x, z in cells}
    assert got == {k: (v[0], v[3]) for k, v in want.items()}
    empty = spark.createDataFrame([], "x long, z long")
    assert grid.nearest_fill(spark.createDataFrame(known, "x long, z long, h double"), empty).count() == 0
    with pytest.raises(Exception, match="known cell"):
        grid.nearest_fill(spark.createDataFrame([], "x long, z long, h double"), spark.createDataFrame(cells, "x long, z long")).count()


def test_pool_rules(spark):
    def pooled(cells, level):
        return {(r.x, r.y, r.z): r.cls for r in grid.pool_majority(spark.createDataFrame(cells, "x long, y long, z long, cls long"), level).collect()}

    cube = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    assert pooled([(*p, 1) for p in cube[:3]], 1) == {}
    assert pooled([(*p, 1) for p in cube[:4]], 1) == {(0, 0, 0): 1}
    assert pooled([(0, 0, 0, 7)], 1) == {(0, 0, 0): 7}
    assert pooled([(0, 0, 0, 7)], 2) == {}
    assert pooled([(*p, 1) for p in cube[:3]] + [(*cube[3], 7)], 2) == {}  # thin cells are out before counting
    assert pooled([(*p, 6) for p in cube[:2]], 3) == {(0, 0, 0): 6}


def test_merge_rules(spark):
    rows = [(0, 0, 1, None, None, 3.0, None, 6, 0, False), (0, 0, 2, 5.0, None, 2.0, None, 2, 1, True), (0, 0, 3, 7.0, 1.0, None, None, 3, 1, False)]
    t = spark.createDataFrame(rows, "x long, z long, tile int, h double, w double, bh double, deck double, rc int, rc_lod int, cover boolean")
    r = grid.merged_tiles(t).first()
    assert (r.h, r.w, r.bh, r.deck, r.rc, r.rc_lod, r.cover) == (5.0, 1.0, 3.0, None, 3, 1, True)


def test_last_span_wins(spark):
    lay = spark.createDataFrame([(0, 0, -8.0, -8.0, None, None, None, 0, True)], "x long, z long, h double, known_h double, w double, bh double, deck double, rc int, cover boolean")
    spans = spark.createDataFrame([(0, 0, 5, 9, 10), (0, 0, 7, 8, 7), (0, 0, 7, 8, 6)], "x long, z long, y0 long, y1 long, cls long")
    got = {r.y: r.cls for r in grid.composed(lay, spans).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 5: 10, 6: 10, 7: 7, 8: 7, 9: 10}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(a, b) for a, b in ((rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)) if a != b] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.label for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}


def test_bridges_make_a_shortest_forest(spark):
    rng = random.Random(7)
    rows = [(1, i, rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(14)]
    rows += [(1, 100, 2.0, 2.0, 3.0, 3.0), (1, 101, 3.0, 3.0, 4.0, 2.0)]
    got = graph.bridge_gaps(spark.createDataFrame(rows, "river int, line int, lon0 double, lat0 double, lon1 double, lat1 double"), "river").collect()
    ends = [p for r in rows for p in ((r[2], r[3]), (r[4], r[5]))]
    # Prim's tree over pieces, limited to 1.5
    piece = list(range(len(rows)))
    find = lambda i: i if piece[i] == i else find(piece[i])
    for i in range(len(ends)):
        for j in range(i):
            if ends[i] == ends[j]:
                piece[find(i // 2)] = find(j // 2)
    total, n = 0.0, 0
    for d, i, j in sorted((math.dist(ends[i], ends[j]), j, i) for i in range(len(ends)) for j in range(i)):
        if d < 1.5 and find(i // 2) != find(j // 2):
            piece[find(i // 2)] = find(j // 2)
            total, n = total + d, n + 1
    assert len(got) == n
    assert sum(math.hypot(r.x0 - r.x1, r.y0 - r.y1) for r in got) == pytest.approx(total)


def test_shelves_do_not_overlap(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randint(5, 60), rng.randint(5, 90)) for i in range(80)]
    d = spark.createDataFrame(sizes, "id int, w int, h int")
    got = {r.id: r for r in graph.shelf_pack(d, 200, 2).collect()}
    for i, w, h in sizes:
        assert got[i].x + w <= 200 and got[i].y + h <= 200
        for j, v, k in sizes[:i]:
            if got[i].page == got[j].page:
                a, b = got[i], got[j]
                assert a.x + w <= b.x or b.x + v <= a.x or a.y + h <= b.y or b.y + k <= a.y
    apart = graph.shelf_pack(d.withColumn("a", c("id") % 2), 200, 2, "a")
    assert apart.columns == ["a", "id", "page", "x", "y"] and apart.count() == 80
    assert {(r.id, r.page, r.x, r.y) for r in apart.collect() if r.a == 1} == {tuple(r) for r in graph.shelf_pack(d.filter("id % 2 = 1"), 200, 2).collect()}


def test_shelves_are_first_fit(spark):
    """Each rectangle, the tallest first, is on the first page whose open shelf, or room below it, holds it."""
    rng = random.Random(3)
    sizes = [(i, rng.randint(5, 150), rng.randint(5, 120)) for i in range(200)]
    got = {r.id: (r.page, r.x, r.y) for r in graph.shelf_pack(spark.createDataFrame(sizes, "id int, w int, h int"), 256, 2).collect()}
    open_, below = {}, {}  # of each page the shelf's (y, used width), and the room's top below it
    for i, w, h in sorted(sizes, key=lambda r: (-r[2], r[0])):
        for page in range(len(open_) + 1):
            y, used = open_.get(page, (2, 2))
            if page not in open_ or used + w + 2 <= 256:
                below.setdefault(page, y + h + 2)
                break
            if below[page] + h + 2 <= 256:
                y, used = below[page], 2
                below[page] += h + 2
                break
        assert got[i] == (page, used, y)
        open_[page] = (y, used + w + 2)


def _random_windows(n, seed):
    rng = random.Random(seed)
    place, cls, size = [], [], []
    for at in range(n * symbols.COLUMNS):
        s, b = rng.randint(1, 30), rng.randint(1, 20)
        kinds = [[], [(1, s)], [(1, s), (2, 1)], [(1, s), (8, 1)], [(1, s), (4, b), (5, 1)], [(1, s), (4, b)], [(1, s), (5, 1)], [(1, s), (0, 2), (6, 5000)], [(12, 3)], [(1, s), (2, 2)], [(0, 4), (6, 2)]]
        for k, m in rng.choice(kinds):
            place.append(at)
            cls.append(k)
            size.append(m)
    return symbols.Runs(n, np.array(place), np.array(cls), np.array(size))


def _trained(r, groups):
    place, table, context, sym = symbols.steps(r)
    use = table >= 0
    key, n = np.unique(np.stack((groups[place[use] // symbols.COLUMNS], table[use], context[use], sym[use])), axis=1, return_counts=True)
    counts = {}
    for g, t, x, s, k in zip(*key.tolist(), n.tolist(), strict=True):
        counts.setdefault((g, t, x), np.zeros(symbols.TABLES[t][1]))[s] += k
    return symbols.Model.of(zip(*[(*k, s, f) for k, v in counts.items() for s, f in enumerate(symbols.scaled(v)[0])], strict=True))


def test_codec_round_trip_on_random_windows():
    r, groups = _random_windows(7, 11), np.array([0, 1, 2, 3, 4, 0, 1])
    model = symbols.Model.from_bytes(_trained(r, groups).to_bytes())
    heights = np.arange(70, 77)
    blobs = symbols.encode(r, heights, groups, model)
    got, back = symbols.decode(blobs, groups, model)
    assert (got == heights).all()
    assert all((getattr(back, k) == getattr(r, k)).all() for k in ("place", "cls", "size"))
    # windows do not depend on those they are coded beside
    cut = r.first()[3 * symbols.COLUMNS]
    alone = symbols.Runs(4, r.place[cut:] - 3 * symbols.COLUMNS, r.cls[cut:], r.size[cut:])
    assert symbols.encode(alone, heights[3:], groups[3:], model) == blobs[3:]
    # trained tables are shorter than uniform ones
    assert sum(map(len, blobs)) < sum(map(len, symbols.encode(r, heights, groups, symbols.Model())))
    with pytest.raises(ValueError, match="version"):
        symbols.decode([b"\x07" + blobs[0][1:]], groups[:1], model)
    none = symbols.Runs(0, *[np.empty(0, np.int64)] * 3)
    assert symbols.encode(none, heights[:0], groups[:0], model) == [] and symbols.decode([], groups[:0], model)[1].n == 0


def test_symbols_of_a_known_window():
    """A flat floor of height 5 with one house of height 9 at (3, 0) and a pole over air at (4, 0)."""
    flat = {at: [(1, 5)] for at in range(symbols.COLUMNS)}
    flat[3], flat[4] = [(1, 5), (4, 4), (5, 1)], [(0, 2), (7, 3)]
    rows = [(at, k, n) for at, runs in flat.items() for k, n in runs]
    place, table, context, sym = symbols.steps(symbols.Runs(1, *map(np.array, zip(*rows, strict=True))))
    by = {}
    for p, *op in zip(place.tolist(), table.tolist(), context.tolist(), sym.tolist(), strict=True):
        by.setdefault(p, []).append(tuple(op))
    out = symbols.OUTSIDE
    assert by[0] == [(symbols.PATTERN_T, out * 40 + out * 4 + 3, 1), (symbols.SURFACE_T, 2 * 35 + 2 * 7, 10)]
    assert by[1] == [(symbols.PATTERN_T, 40 + out * 4 + 3, 1), (symbols.SURFACE_T, 2 * 35 + 2 * 7, 0)]
    assert by[3] == [(symbols.PATTERN_T, 40 + out * 4 + 3, 4), (symbols.SURFACE_T, 2 * 35 + 2 * 7 + 3, 0), (symbols.SAME_T, 0, 3), (symbols.WALL_T, 0, 3)]
    assert by[4] == [(symbols.PATTERN_T, 4 * 40 + out * 4 + 3, 8), (symbols.RUNS_T, 0, 1), (symbols.CLASS_T, 13, 0), (symbols.LENGTH_T, 0, 1), (symbols.CLASS_T, 0, 7), (symbols.LENGTH_T, 7, 2)]
    # the pole has no ground of its own and takes what is predicted, so what follows is flat again
    assert by[5][1] == (symbols.SURFACE_T, 2 * 35 + 2 * 7, 0)


def test_scaled_tables():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 1000, 25) * (rng.random(25) < 0.5) for _ in range(20)] + [np.where(np.arange(25) == 3, 10**7, 0), np.zeros(25)]
    for counts, f in zip(rows, symbols.scaled(np.array(rows)), strict=True):
        assert f.sum() == 4096 and f.min() >= 1
        # each is within the rounds dealt of its rounded share, and larger counts never get less
        share = np.maximum(1, np.rint((counts + 0.25) / (counts + 0.25).sum() * 4096))
        assert np.abs(f - share).max() <= 1 + abs(4096 - share.sum())
        assert (np.diff(f[np.argsort(counts, kind="stable")]) >= -1).all()
    assert codec.from_byte_planes(codec.byte_planes(np.arange(5000))).tolist() == list(range(5000))


def test_offsets_never_straddle(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 900)) for i in range(300)]
    got = {r.slot: r.offset for r in codec.with_offsets(spark.createDataFrame(rows, "slot long, len long"), "slot", "len", 1000).collect()}
    at = 0
    for i, n in rows:
        if at % 1000 + n > 1000:
            at = (at // 1000 + 1) * 1000
        assert got[i] == at
        at += n


def test_archive(spark, tmp_path):
    rows = [(lv, x, z, 3, bytearray(b"a" * (1 + lv + x + z))) for lv in (0, 4, 5, 6) for x in range(3) for z in range(2)]
    d = codec.write_archive(spark.createDataFrame(rows, "level long, cx long, cz long, height long, blob binary"), str(tmp_path / "a"))
    order = [(r.level, r.cx, r.cz) for r in d.orderBy("offset").collect()]
    assert [lv for lv, _, _ in order[:12]] == [6] * 6 + [5] * 6
    assert sorted(order) == sorted((r[0], r[1], r[2]) for r in rows)
    assert spark.read.parquet(str(tmp_path / "a/manifest")).agg(F.sum("chunks")).first()[0] == len(rows)


def test_quadtree_edges(spark):
    """A node whose children are all absent stays; one whose children are all out of sight emits nothing."""
    far = [{"a": -1.0, "b": 0.0, "c": 0.0, "d": 40.0}]  # x <= 40
    v = spark.createDataFrame([(1, 100.0, 1.0, 0.0, far, 0.0, 0.0, 100.0, 100.0)], "view int, ppm double, detail double, pad double, planes array<struct<a:double,b:double,c:double,d:double>>, x0 double, z0 double, x1 double, z1 double")
    absent = spark.createDataFrame([(1, 0, 0, 1)], "level long, cx long, cz long, height long")
    assert [tuple(r)[1:] for r in view.select_chunks(v, absent, 1).collect()] == [(1, 0, 0)]
    hidden = spark.createDataFrame([(1, 0, 0, 1), (0, 1, 0, 1)], "level long, cx long, cz long, height long")
    v2 = v.withColumn("planes", F.expr("array(named_struct('a', -1.0D, 'b', 0.0D, 'c', 0.0D, 'd', 20.0D))"))
    assert view.select_chunks(v2, hidden, 1).collect() == []


def test_greedy_batches_against_a_walk(spark):
    rng = random.Random(4)
    rows = [(s, 0, i, s, float(rng.randint(0, 500)), rng.randint(0, 600) * 1000, rng.randint(1, 5000), rng.choice(["build", "fetch", "wait"])) for s in range(3) for i in range(120)]
    got = view.greedy_batches(spark.createDataFrame(rows, "session int, level long, cx long, cz long, score double, offset long, len long, mode string"), "session").toPandas()
    for s in range(3):
        jobs = sorted((r for r in rows if r[0] == s and r[7] != "wait"), key=lambda r: (r[4], r[1], r[2], r[3]))
        taken, batches = set(), []
        for head in jobs:
            if len(batches) == view.IN_FLIGHT:
                break
            if head[2] in taken:
                continue
            lim = (view.FETCH_CHUNKS, view.FETCH_BYTES) if head[7] == "fetch" else (view.BATCH_CHUNKS, view.BATCH_BYTES)
            lo, hi, mine = head[5], head[5] + head[6], [head[2]]
            for o in jobs:
                if len(mine) >= lim[0]:
                    break
                if o[2] in taken or o[2] in mine or o[7] != head[7]:
                    continue
                a, b = o[5], o[5] + o[6]
                if a > hi + view.BATCH_GAP or b < lo - view.BATCH_GAP or max(hi, b) - min(lo, a) > lim[1]:
                    continue
                mine.append(o[2])
                lo, hi = min(lo, a), max(hi, b)
            taken |= set(mine)
            batches.append(set(mine))
        mine = got[got.session == s]
        assert [set(g.cx) for _, g in mine.groupby("batch")] == batches


def test_stalled_flight(spark):
    rows = [(1, i, 16.0, 1000.0, 0.2 if i < 200 else 1.0) for i in range(400)]
    got = view.stall_clock(spark.createDataFrame(rows, "f int, i long, dt double, duration double, ready double"), "f").toPandas().sort_values("i")
    clock = held = 0.0
    for u, r in zip(got.u, rows, strict=True):
        slow = clock / 1000 > 0.5 and r[4] < 0.9 and held < 4000
        held += 16 if slow else 0
        clock = min(1000.0, clock + 16 * (0.08 if slow else 1))
        assert u == pytest.approx(clock / 1000)


def test_poles_of_a_made_cloud(spark):
    pole = [(10.1 + 0.01 * k, 20.1, 0.5 + 0.25 * i) for i in range(24) for k in range(5)]
    wall = [(30 + 0.25 * j, 30.1, 0.5 + 0.25 * i) for i in range(24) for j in range(24) for _ in range(3)]
    p = spark.createDataFrame(pole + wall, "x double, y double, z double")
    ground = p.select(F.floor("x").alias("ix"), F.floor("y").alias("iz"), F.lit(0.0).alias("h")).distinct()
    bins = points.pole_bins(p, ground)
    labels = graph.cell_components(bins.select(c("fu").alias("x"), c("fv").alias("z")), True)
    got = points.poles(bins, labels).collect()
    near = [r for r in got if abs(r.u - 10.1) < 0.3 and abs(r.v - 20.1) < 0.3]
    assert len(near) == 1 and near[0].top >= 4


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "x long, y long, z long, cls long")
    assert grid.pool_majority(empty, 1).count() == 0
    assert grid.exposed_faces(empty).count() == 0
    assert codec.column_runs(empty, ["x", "z"]).count() == 0
    assert isinstance(grid.class_histogram(empty, ["x"]).toPandas(), pd.DataFrame)


def test_delaunay_circles_are_empty(spark):
    rng = random.Random(9)
    pts = [(t, rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0, 3)) for t in (1, 2) for _ in range(40)] + [(3, 0.0, 0.0, 1.0), (3, 1.0, 1.0, 1.0)]
    got = graph.delaunay(spark.createDataFrame(pts, "tile int, x double, z double, h double"), "tile").toPandas()
    assert set(got.tile) == {1, 2}
    for t, tris in got.groupby("tile"):
        own = np.array([p[1:3] for p in pts if p[0] == t])
        area = 0.0
        for r in tris.itertuples():
            a, b, d = np.array([r.x0, r.z0]), np.array([r.x1, r.z1]), np.array([r.x2, r.z2])
            m = np.linalg.solve(2 * np.array([b - a, d - a]), [b @ b - a @ a, d @ d - a @ a])
            assert (np.linalg.norm(own - m, axis=1) >= np.linalg.norm(a - m) - 1e-7).all()
            area += abs((b - a)[0] * (d - a)[1] - (b - a)[1] * (d - a)[0]) / 2
        assert area == pytest.approx(hull_area(sorted(map(tuple, own))), rel=1e-3)


def hull_area(points):
    def chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(points) + chain(points[::-1])
    return abs(sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def test_rings_are_stitched(spark):
    line = lambda *p: [{"x": float(a), "z": float(b)} for a, b in p]
    rows = [(1, "outer", 0, line((0, 0), (4, 0))), (1, "outer", 1, line((4, 4), (4, 0))), (1, "outer", 2, line((4, 4), (0, 4), (0, 0))), (1, "outer", 3, line((9, 9), (8, 8))), (1, "inner", 4, line((1, 1), (2, 1), (2, 2), (1, 1)))]
    got = {(r.role, r.part): len(r.ring) for r in graph.stitched_rings(spark.createDataFrame(rows, "id int, role string, seq int, line array<struct<x:double,z:double>>")).collect()}
    assert got == {("outer", 0): 5, ("inner", 0): 4}


def test_directory_bytes():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 900, 400) * (rng.random(400) < 0.7)
    h = rng.integers(1, 90, 400)
    at, want = 0, []
    for i, size in enumerate(n.tolist()):
        if size:
            if at % 4096 + size > 4096:
                at = (at // 4096 + 1) * 4096
            want.append((i, size, int(h[i]), at))
            at += size
    assert [tuple(r) for r in zip(*(v.tolist() for v in codec.read_directory(codec.directory_bytes(n, h), 4096)), strict=True)] == want
    with pytest.raises(ValueError):
        codec.directory_bytes(np.array([70000]), np.array([1]))


def test_checked_rows(spark):
    from gridspan.sources.dims import checked

    d = spark.createDataFrame([(1,), (None,)], "a int")
    assert checked(d.filter("a = 1"), {"positive": c("a") > 0}).count() == 1
    with pytest.raises(Exception, match="positive"):
        checked(d, {"positive": c("a") > 0}).collect()


PLANES = "array<struct<a:double,b:double,c:double,d:double>>"


@pytest.mark.parametrize("most", [100_000, 0])
def test_views_are_not_broadcast(spark, monkeypatch, most):
    """Levels of the directory are joined to the nodes, never the nodes to them, whatever their estimated size."""
    monkeypatch.setattr(view, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    chunks = {(lv, rng.randrange(16 >> lv), rng.randrange(16 >> lv)) for lv in range(3) for _ in range(300 >> 2 * lv)}
    directory = spark.createDataFrame([(*k, 1 + sum(k) % 5) for k in chunks], "level long, cx long, cz long, height long")
    views = [(i, rng.choice([0.3, 0.9, 4.0]), 1.0, 0.0, [{"a": 1.0, "b": 0.0, "c": 0.0, "d": -x}, {"a": 0.0, "b": 0.0, "c": -1.0, "d": z}], x, 0.0, 511.0, z) for i in range(40) for x, z in [(rng.uniform(0, 500), rng.uniform(0, 500))]]
    v = spark.createDataFrame(views, f"view long, ppm double, detail double, pad double, planes {PLANES}, x0 double, z0 double, x1 double, z1 double")
    got = view.select_chunks(v, directory, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin" if most else "SortMergeJoin") >= 3

    def walk(i, ppm, planes, level, x, z):
        if (level, x, z) not in chunks or (x + 1) * (32 << level) + planes[0]["d"] < 0 or planes[1]["d"] - z * (32 << level) < 0:
            return []
        kids = [(a, b) for a in (2 * x, 2 * x + 1) for b in (2 * z, 2 * z + 1) if (level - 1, a, b) in chunks]
        if not kids or ppm * (1 << level) <= 1.0:
            return [(i, level, x, z)]
        return [r for a, b in kids for r in walk(i, ppm, planes, level - 1, a, b)]

    want = [r for i, ppm, _, _, planes, *_ in views for x in range(4) for z in range(4) for r in walk(i, ppm, planes, 2, x, z)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_nearest_fill_without_known_cells(spark):
    none = spark.createDataFrame([], "x long, z long, h long")
    assert grid.nearest_fill(none, spark.createDataFrame([(1, 2), (3, 4)], "x long, z long"), required=False).collect() == []


def test_nearest_of_class_by_exact_distances(spark):
    """Points as decimals lie in the cell they name, and equal distances are equal."""
    p = spark.createDataFrame([(470, Decimal("73.90"), Decimal("109.30")), (1, Decimal("18.00"), Decimal("0.00"))], "id long, px decimal(6,2), pz decimal(6,2)")
    cells = [(75, 109), (72, 108), (12, 0), (24, 0)]  # 1.6, 0.2 away and 1.4, 0.8 away: equal, so the smaller z
    tops = spark.createDataFrame([(x, z, 0, 9, 4) for x, z in cells], "x long, z long, ground long, top long, top_class long")
    got = {r.id: (float(r.ax), float(r.az), r.building) for r in grid.nearest_of_class(p, tops, [4, 5]).collect()}
    assert got == {470: (72.5, 108.5, True), 1: (12.5, 0.5, True)}


def test_planes_in_tenths(spark):
    """Decimal planes are summed exactly and rounded once, then the plane's offset and margin follow."""
    tenth = lambda v: F.lit(Decimal(v)).cast("decimal(2,1)")
    rows = [(x, y, z, 0.6 * a + 0.8 * b) for a in range(0, 7000, 83) for b in range(0, 5500, 97) for x, y, z in [(a + 24, 16, b + 105)]]
    d = spark.createDataFrame(rows, "x long, y long, z long, d double")
    plane = F.array(F.struct(tenth("0.6").alias("a"), tenth("0.1").alias("b"), tenth("0.8").alias("c"), (-c("d")).alias("d"), F.lit(100.0).alias("m")))
    got = [r.v for r in d.select(view.in_view(plane, F.lit(0), F.lit(0), F.lit(0), c("x"), c("y"), c("z"), True).alias("v")).collect()]
    assert got == [(6 * x + y + 8 * z) / 10 - d >= 100 for x, y, z, d in rows] and len(set(got)) == 2


def test_roots_that_a_box_touches(spark):
    """The box starts where the padded root ends: that root is in sight as well."""
    v = spark.createDataFrame([(1, 0.1, 1.0, 24.0, [{"a": 1.0, "b": 0.0, "c": 0.0, "d": -88.0}], 88.0, 0.0, 90.0, 10.0)], f"view long, ppm double, detail double, pad double, planes {PLANES}, x0 double, z0 double, x1 double, z1 double")
    directory = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 1)], "level long, cx long, cz long, height long")
    assert sorted(tuple(r) for r in view.select_chunks(v, directory, 1).collect()) == [(1, 1, 0, 0), (1, 1, 1, 0)]


def test_close_pairs_by_the_root_of_squares(spark):
    """A distance is the root of the sum of squares, which a hypot may miss by the last bit."""
    rng = random.Random(2)
    pts = [(g, 2 * g + k, x, y) for g in range(20_000) for x0, y0 in [(rng.randrange(3600) / 200, rng.randrange(1700) / 200)] for k, x, y in ((0, x0, y0), (1, x0 + 0.9, y0 + 1.2))]
    got = {r.g for r in grid.close_pairs(spark.createDataFrame(pts, "g long, id long, x double, y double"), "g", 1.5).collect()}
    ends = list(zip(pts[::2], pts[1::2], strict=True))
    root = {a[0] for a, b in ends if math.sqrt((a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3])) < 1.5}
    assert got == root


def test_byte_runs_at_one_offset(spark):
    """Chunks at one offset are in order of length, so the run after them does not hang on the order of rows."""
    rows = [(1, 0, 50), (1, 0, 2), (1, 4100, 10)]
    for r in (rows, rows[::-1]):
        got = view.byte_runs(spark.createDataFrame(r, "session long, offset long, len long").coalesce(1), ["session"], 1_000_000).collect()
        assert [tuple(x) for x in got] == [(1, 1, 0, 4110, 3)]


def test_alias_query_goes_past_the_guard_of_its_sql(spark, tmp_path):
    """On chains of more than 16 links the query has the rows of its SQL without the guard, names once each."""
    part = [(1 << i, 30) for i in range(21)] + [(3 << i, 30 if i % 5 else 20) for i in range(18)] + [(1 << 20, 30)]
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["s02_alias_chains"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    sql = catalog.ORACLES["s02_alias_chains"]
    assert "d < 16" in sql and got == sorted(db.execute(sql.replace("d < 16", "d < 1000")).fetchall())
    assert dict(got)[1 << 20] == 1 and dict(db.execute(sql).fetchall())[1 << 20] == 16
