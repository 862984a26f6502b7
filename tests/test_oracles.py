"""Every core query against its DuckDB SQL on the small tables."""

import math
import os

import duckdb
import pytest

from gridspan.operators import view
from gridspan.plans import catalog
from gridspan.plans.registry import FIXTURES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(frame, names):
    return sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None))


# --- queries whose rows depend on an order that SQL does not walk: plain versions of the whole result -------


def plain_batches(duck, got):
    """The most urgent job left opens a batch; others of its mode join it in order while they lie near."""
    rows = duck.execute("SELECT o_custkey % 20, o_totalprice, o_orderkey % 7, o_orderkey, o_custkey, (o_orderkey * 7919 % 300000) * 100, 1 + o_orderkey % 900, o_orderkey % 3 = 0 FROM orders").fetchall()
    want = set()
    for session in {r[0] for r in rows}:
        left, number = sorted(r[1:] for r in rows if r[0] == session), 0
        while left and number < view.IN_FLIGHT:
            head = left.pop(0)
            lo, hi, mine, rest = head[4], head[4] + head[5], [head], []
            count, span = (view.FETCH_CHUNKS, view.FETCH_BYTES) if head[6] else (view.BATCH_CHUNKS, view.BATCH_BYTES)
            for job in left:
                a, b = min(lo, job[4]), max(hi, job[4] + job[5])
                near = lo - view.BATCH_GAP <= job[4] + job[5] and job[4] <= hi + view.BATCH_GAP
                if job[6] == head[6] and near and b - a <= span and len(mine) < count:
                    lo, hi = a, b
                    mine.append(job)
                else:
                    rest.append(job)
            want |= {(session, number, *j[1:4]) for j in mine}
            left, number = rest, number + 1
    assert set(got[["session", "batch", "level", "cx", "cz"]].itertuples(index=False, name=None)) == want and len(got) == len(want)


def plain_shelves(duck, got):
    """First fit: the first page whose open shelf, or room below it, holds the image."""
    at = {r.id: (r.page, r.x, r.y) for r in got.itertuples()}
    pages = []
    for h, i, w in sorted(duck.execute("SELECT -(5 + p_size * 4), p_partkey, 10 + p_partkey * 37 % 300 FROM part").fetchall()):
        h = -h
        for n in range(len(pages) + 1):
            if n == len(pages):
                pages.append([2, 2, 4 + h])
            elif pages[n][0] + w + 2 > 4096:
                if pages[n][2] + h + 2 > 4096:
                    continue
                pages[n] = [2, pages[n][2], pages[n][2] + h + 2]
            assert at.pop(i) == (n, pages[n][0], pages[n][1])
            pages[n][0] += w + 2
            break
    assert not at


def plain_bridges(duck, got):
    """Of each river as many bridges, of the same length in all, as nearest-first joining of its pieces."""
    by = {}
    for r in duck.execute(f"WITH {FIXTURES['line_end']} SELECT river, line, lon0, lat0, lon1, lat1 FROM line_end ORDER BY 1, 2").fetchall():
        by.setdefault(r[0], []).append(r[2:])
    found = {k: (len(g), sum(math.hypot(r.x0 - r.x1, r.y0 - r.y1) for r in g.itertuples())) for k, g in got.groupby("river")}
    for river, lines in by.items():
        piece = list(range(len(lines)))
        ends = [(k, p) for k, r in enumerate(lines) for p in (r[:2], r[2:])]
        pairs = sorted((math.dist(p, q), i, j) for a, (i, p) in enumerate(ends) for j, q in ends[a + 1 :] if i != j)
        n, total = 0, 0.0
        for d, i, j in pairs:
            if d < 1.5 and piece[i] != piece[j]:
                n, total = n + (d > 0), total + d
                piece = [piece[i] if v == piece[j] else v for v in piece]
        assert found.get(river, (0, 0.0)) == (n, pytest.approx(total, abs=1e-4)), river


def plain_demand(duck, got):
    """Coarser chunks are wanted no later than those below them, and each path's ends are covered."""
    assert len(got) and not got.duplicated(["flight", "level", "cx", "cz"]).any()
    score = {r[:4]: r[4] for r in got[["flight", "level", "cx", "cz", "score"]].itertuples(index=False, name=None)}
    there = set(duck.execute(f"WITH {FIXTURES['chunk']} SELECT level, cx, cz FROM chunk").fetchall())
    for (f, level, x, z), s in score.items():
        if level < view.TOP:
            assert score[f, level + 1, x >> 1, z >> 1] <= s
    assert {k[1:] for k in score if k[1] == view.TOP} <= there
    flights = duck.execute("SELECT s_suppkey, (s_suppkey * 397 % 6000), (s_suppkey * 211 % 5000) FROM supplier").fetchall()
    for f, x, z in flights:
        if (view.TOP, x >> 11, z >> 11) in there:
            assert (f, view.TOP, x >> 11, z >> 11) in score


def plain_cloud(duck, got):
    """One class a cell, no cell outside the cloud, and every column filled from the floor."""
    assert len(got) and not got.duplicated(["x", "y", "z"]).any() and got.cls.between(1, 12).all()
    columns = {r for r in duck.execute(f"WITH {FIXTURES['point']} SELECT DISTINCT floor(x)::BIGINT, floor(y)::BIGINT FROM point").fetchall()}
    held = got[got.y == 0].groupby(["x", "z"]).size()
    assert set(held.index) == set(got.groupby(["x", "z"]).size().index) and set(held.index) <= columns


PLAIN = {"w06_greedy_batches": plain_batches, "o08_k02_shelf_packed_pages": plain_shelves, "g01_o05_bridged_gaps": plain_bridges, "t02_flight_demand": plain_demand, "lidar_voxels": plain_cloud}


def test_every_query_is_compared():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) | set(PLAIN)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLES:
        PLAIN[name](duck, got)
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert rows(got, names) == rows(want, names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4 * 13
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_nested_loops(spark, sf):
    """Spatial and range joins are equi-joins on bins."""
    for name in ("j06_polygon_cells", "j08_triangle_raster", "j10_c10_detail_blocks", "j12_anchors", "j13_close_ends", "j14_lamp_light", "g06_distance_bands", "f22_tasks_in_windows", "g13_f18_f19_f20_selected_chunks"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
