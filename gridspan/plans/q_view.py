"""Queries of views: selection, demand, fetching, display, eviction, and graphs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.operators import graph, view
from gridspan.plans.registry import Tables, fixture, out, query

c = F.col

_PLANES = "[{'a': 1.0, 'b': 0.0, 'c': 0.0, 'd': -x0}, {'a': -1.0, 'b': 0.0, 'c': 0.0, 'd': x1}, {'a': 0.0, 'b': 0.0, 'c': 1.0, 'd': -z0}, {'a': 0.0, 'b': 0.0, 'c': -1.0, 'd': z1}, {'a': 0.6, 'b': 0.1, 'c': 0.8, 'd': -(0.6 * x0 + 0.8 * z0) - 100}, {'a': 0.0, 'b': -1.0, 'c': 0.0, 'd': 900.0}]"


@fixture("camera", "SELECT s_suppkey AS id, (s_suppkey * 7919 % 7000)::DOUBLE AS x0, (s_suppkey * 104729 % 5500)::DOUBLE AS z0, (s_suppkey * 7919 % 7000)::DOUBLE + 400 + s_suppkey % 900 AS x1, (s_suppkey * 104729 % 5500)::DOUBLE + 300 + s_suppkey % 700 AS z1, 0.05 + (s_suppkey % 10) / 4.0::DOUBLE AS ppm FROM supplier")
def _camera(t: Tables) -> DataFrame:
    """Boxes of ground in sight, with a scale."""
    k = c("s_suppkey")
    x, z = (k * 7919 % 7000).cast("double"), (k * 104729 % 5500).cast("double")
    return t.supplier.select(k.alias("id"), x.alias("x0"), z.alias("z0"), (x + 400 + k % 900).alias("x1"), (z + 300 + k % 700).alias("z1"), (0.05 + (k % 10) / 4.0).alias("ppm"))


def _views(t: Tables) -> DataFrame:
    tenths = lambda v: F.lit(Decimal(v)).cast("decimal(2,1)")
    p = lambda a, b, cc, d, m="0": F.struct(tenths(a).alias("a"), tenths(b).alias("b"), tenths(cc).alias("c"), d.alias("d"), F.lit(float(m)).alias("m"))
    planes = F.array(p("1.0", "0", "0", -c("x0")), p("-1.0", "0", "0", c("x1")), p("0", "0", "1.0", -c("z0")), p("0", "0", "-1.0", c("z1")), p("0.6", "0.1", "0.8", -(0.6 * c("x0") + 0.8 * c("z0")), "100"), p("0", "-1.0", "0", F.lit(900.0)))
    return t.camera.select(c("id").alias("view"), "ppm", F.lit(2.0).alias("detail"), F.lit(24).cast("long").alias("pad"), planes.alias("planes"), "x0", "z0", "x1", "z1")


_SEEN = """(SELECT count(*) FROM (SELECT unnest(planes) AS p) WHERE (CASE WHEN p.a > 0 THEN (k.cx + 1) * (32 << k.level::INT) + 24 ELSE k.cx * (32 << k.level::INT) - 24 END) * p.a + (CASE WHEN p.b > 0 THEN k.height * (1 << k.level::INT) + 24 ELSE 0 END) * p.b + (CASE WHEN p.c > 0 THEN (k.cz + 1) * (32 << k.level::INT) + 24 ELSE k.cz * (32 << k.level::INT) - 24 END) * p.c + p.d < 0) = 0"""
_BOX = """((k.cx + 1) * (32 << k.level::INT) + 24 >= v.x0 AND k.cx * (32 << k.level::INT) - 24 <= v.x1 AND (k.cz + 1) * (32 << k.level::INT) + 24 >= v.z0 AND k.cz * (32 << k.level::INT) - 24 <= v.z1
    AND 0.6 * ((k.cx + 1) * (32 << k.level::INT) + 24) + 0.1 * (k.height * (1 << k.level::INT) + 24) + 0.8 * ((k.cz + 1) * (32 << k.level::INT) + 24) - (0.6 * v.x0 + 0.8 * v.z0) - 100 >= 0)"""
_WALK = f"""kids AS (SELECT DISTINCT level + 1 AS level, cx >> 1 AS cx, cz >> 1 AS cz FROM directory WHERE level < 6), node AS (SELECT d.*, k.cx IS NOT NULL AS has_kids FROM directory d LEFT JOIN kids k USING (level, cx, cz)),
    walk AS (SELECT v.id, k.level, k.cx, k.cz, (k.level > 0 AND (1 << k.level::INT) * v.ppm > 2 AND k.has_kids) AS split FROM camera v JOIN node k ON k.level = 6 AND {_BOX}
    UNION ALL SELECT w.id, k.level, k.cx, k.cz, (k.level > 0 AND (1 << k.level::INT) * v.ppm > 2 AND k.has_kids) FROM walk w JOIN camera v ON v.id = w.id JOIN node k ON k.level = w.level - 1 AND (k.cx >> 1) = w.cx AND (k.cz >> 1) = w.cz WHERE w.split AND {_BOX})"""


@query("g13_f18_f19_f20_selected_chunks", f"WITH RECURSIVE {_WALK} SELECT id AS view, level, cx, cz FROM walk WHERE NOT split", ("chunk", "directory", "camera"))
def g13(t: Tables) -> DataFrame:
    """The chunks that cameras draw: a quadtree walk with a frustum and a screen-error test."""
    return out(view.select_chunks(_views(t), t.directory), view="long", level="long", cx="long", cz="long")


fixture("wish", "SELECT (c_custkey % 40) AS session, (c_custkey % 3)::BIGINT AS level, ((c_custkey * 37 % 256) >> (c_custkey % 3)::INT)::BIGINT AS cx, ((c_custkey * 11 % 200) >> (c_custkey % 3)::INT)::BIGINT AS cz, (c_custkey * 13 % 4000)::DOUBLE AS t FROM customer")(
    lambda t: t.customer.select((c("c_custkey") % 40).alias("session"), (c("c_custkey") % 3).cast("long").alias("level"), F.floor((c("c_custkey") * 37 % 256) / F.pow(F.lit(2.0), c("c_custkey") % 3)).cast("long").alias("cx"), F.floor((c("c_custkey") * 11 % 200) / F.pow(F.lit(2.0), c("c_custkey") % 3)).cast("long").alias("cz"), (c("c_custkey") * 13 % 4000).cast("double").alias("t"))
)
fixture("built", "SELECT level, cx, cz FROM directory WHERE height >= 15 OR level = 6")(lambda t: t.directory.filter("height >= 15 OR level = 6").select("level", "cx", "cz"))

_ANC = "SELECT *, al::BIGINT AS al2, cx >> (al - level)::INT AS ax, cz >> (al - level)::INT AS az FROM wish, LATERAL (SELECT unnest(range(level, 7)) AS al) a"


@query("o03_j19_t02_demand", f"SELECT session, al2 AS level, ax AS cx, az AS cz, min(t + 250 * (6 - al)) AS score FROM ({_ANC}) GROUP BY 1, 2, 3, 4", ("wish",))
def o03(t: Tables) -> DataFrame:
    """Wanted chunks and all their ancestors by urgency, the least of each."""
    return out(view.demand(t.wish, ["session"]), session="long", level="long", cx="long", cz="long", score="double")


@query("t01_plan_left", "SELECT session, level, cx, cz, greatest(0, t - 1500) + 250 * (6 - level) AS score FROM wish WHERE t - 1500 >= -400", ("wish",))
def t01(t: Tables) -> DataFrame:
    return out(view.plan_demand(t.wish, F.lit(1500.0)), session="long", level="long", cx="long", cz="long", score="double")


@query(
    "j17_missing_jobs",
    """WITH d AS (SELECT level, cx, cz, min(t + 250 * (6 - level)) AS score FROM wish GROUP BY 1, 2, 3)
    SELECT level, cx, cz, score FROM d ANTI JOIN built USING (level, cx, cz) ANTI JOIN (SELECT level, cx, cz FROM directory WHERE height < 3) USING (level, cx, cz) ANTI JOIN (SELECT level, cx, cz FROM directory WHERE height BETWEEN 3 AND 5 AND 10000 - (cx * 100) < 3000) USING (level, cx, cz)
    WHERE NOT (score - 250 * (6 - level) > 2000 AND EXISTS (SELECT 1 FROM directory x WHERE x.height BETWEEN 6 AND 9 AND x.level = d.level AND x.cx = d.cx AND x.cz = d.cz))""",
    ("chunk", "directory", "wish", "built"),
)
def j17(t: Tables) -> DataFrame:
    """Demand less what is built, under way, lately failed, or fetched ahead and not due."""
    k = t.directory
    d = t.wish.groupBy(*view.KEY).agg(F.min(c("t") + 250 * (6 - c("level"))).alias("score"))
    part = lambda a, b: k.filter(c("height").between(a, b))
    got = view.missing_jobs(d, t.built, part(1, 2), part(3, 5).withColumn("at", c("cx") * 100.0), part(6, 9), 10000.0)
    return out(got, level="long", cx="long", cz="long", score="double")


@query("j18_t06_dead_batches", "WITH b AS (SELECT level * 1000 + (cx * 3 + cz) % 300 AS batch, level, cx, cz FROM directory) SELECT batch FROM b LEFT JOIN (SELECT DISTINCT level, cx, cz, 1 AS there FROM wish) USING (level, cx, cz) GROUP BY 1 HAVING count(there) = 0", ("chunk", "directory", "wish"))
def j18(t: Tables) -> DataFrame:
    b = t.directory.select((c("level") * 1000 + (c("cx") * 3 + c("cz")) % 300).alias("batch"), *view.KEY)
    return out(view.dead_batches(b, t.wish.select(*view.KEY).distinct()), batch="long")


@query("t04_modes", "SELECT event_id, CASE WHEN warm OR NOT later THEN 'build' WHEN fetched THEN 'wait' ELSE 'fetch' END AS mode FROM (SELECT event_id, event_id % 7 = 0 AS warm, event_id % 3 = 0 AS fetched, (due > 2000 OR (due > 250 AND pend > 58720256)) AS later FROM (SELECT event_id, abs(value) * 40 AS due, (event_id % 4) * 20000000 AS pend FROM events))")
def t04(t: Tables) -> DataFrame:
    """Build, fetch or wait."""
    k = c("event_id")
    m = view.mode(F.abs("value") * 40 + 1500, F.lit(0), k % 7 == 0, (k % 4) * 20000000, k % 3 == 0)
    return out(t.events.select("event_id", m.alias("mode")), event_id="long", mode="string")


@query("j21_readiness", f"SELECT session, round(avg(hit), 9) AS share FROM (SELECT session, a.level, a.cx, a.cz, max(CASE WHEN b.cx IS NULL THEN 0 ELSE 1 END) AS hit FROM ({_ANC}) a LEFT JOIN built b ON b.level = al2 AND b.cx = ax AND b.cz = az WHERE al <= a.level + 1 GROUP BY 1, 2, 3, 4) GROUP BY 1", ("chunk", "directory", "wish", "built"))
def j21(t: Tables) -> DataFrame:
    """Share of a session's chunks that are built, or have a built parent."""
    return out(view.readiness(t.wish, ["session"], t.built, 1), session="long", share="round9")


@query(
    "j20_shown_chunks",
    f"""WITH near AS (SELECT DISTINCT arg_min(b.level, b.level) OVER w AS level, arg_min(b.cx, b.level) OVER w AS cx, arg_min(b.cz, b.level) OVER w AS cz FROM ({_ANC}) a JOIN built b ON b.level = al2 AND b.cx = ax AND b.cz = az WINDOW w AS (PARTITION BY a.level, a.cx, a.cz))
    SELECT level, cx, cz FROM near n WHERE NOT EXISTS (SELECT 1 FROM near o WHERE o.level > n.level AND o.cx = n.cx >> (o.level - n.level)::INT AND o.cz = n.cz >> (o.level - n.level)::INT)""",
    ("chunk", "directory", "wish", "built"),
)
def j20(t: Tables) -> DataFrame:
    """Stand-ins: the nearest built ancestor, nothing finer under one that is shown."""
    return out(view.shown_chunks(t.wish, t.built), level="long", cx="long", cz="long")


@query(
    "j27_ground_at",
    """WITH b AS (SELECT level, cx, cz, i % 32 AS lx, i // 32 AS lz, (cx + cz + level + i) % 9 AS ground FROM built, (SELECT unnest(range(0, 1024)) AS i) WHERE level > 0), p AS (SELECT id, (id * 131 % 8000) + 0.5 AS x, (id * 57 % 6000) + 0.25 AS z FROM place),
    l AS (SELECT id, level, floor(x / (1 << level::INT))::BIGINT AS ix, floor(z / (1 << level::INT))::BIGINT AS iz FROM p, (SELECT unnest(range(0, 7)) AS level)), h AS (SELECT l.id, arg_min(ground * (1 << b.level::INT), b.level)::DOUBLE AS ground FROM l JOIN b ON b.level = l.level AND b.cx = ix // 32 AND b.cz = iz // 32 AND b.lx = ix % 32 AND b.lz = iz % 32 GROUP BY 1)
    SELECT p.id, coalesce(ground, -1.0) AS ground FROM p LEFT JOIN h USING (id)""",
    ("place", "chunk", "directory", "built"),
)
def j27(t: Tables) -> DataFrame:
    """Ground height from the finest built level."""
    i = c("i")
    b = t.built.filter("level > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1023).cast("long")))).select(*view.KEY, (i % 32).alias("lx"), F.floor(i / 32).alias("lz"), ((c("cx") + c("cz") + c("level") + i) % 9).alias("ground"))
    p = t.place.select("id", ((c("id") * 131 % 8000) + 0.5).alias("x"), ((c("id") * 57 % 6000) + 0.25).alias("z"))
    return out(view.finest_at(p, b, "ground").na.fill(-1.0, ["ground"]), id="long", ground="double")


@query("j26_pinned_chunks", "SELECT DISTINCT id, cx, cz FROM (SELECT id, floor((id * 131 % 8000 + 0.5 + dx) / 32)::BIGINT AS cx, floor((id * 57 % 6000 + 0.25 + dz) / 32)::BIGINT AS cz FROM place, (SELECT unnest([-6, 6]) AS dx), (SELECT unnest([-6, 6]) AS dz)) SEMI JOIN (SELECT cx, cz FROM directory WHERE level = 0) USING (cx, cz)", ("place", "chunk", "directory"))
def j26(t: Tables) -> DataFrame:
    p = t.place.select("id", ((c("id") * 131 % 8000) + 0.5).alias("x"), ((c("id") * 57 % 6000) + 0.25).alias("z"))
    return out(view.pinned(p, t.directory), id="long", cx="long", cz="long")


_REFS = "SELECT o_custkey % 50 AS session, (o_orderkey * 7919 % 300000) * 100 AS off, (1 + o_orderkey % 90)::BIGINT AS len FROM orders"


@query(
    "w05_s20_byte_runs",
    f"""WITH r AS ({_REFS}), g AS (SELECT *, CASE WHEN lag(off) OVER w IS NULL OR off // 1000000 <> lag(off) OVER w // 1000000 OR off - (lag(off + len) OVER w) > 4096 THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY session ORDER BY off)), k AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY off) AS run FROM g) SELECT session, run::BIGINT AS run, min(off) AS first, max(off + len) AS last, count(*) AS chunks FROM k GROUP BY 1, 2""",
)
def w05(t: Tables) -> DataFrame:
    """Byte ranges: near chunks of one shard travel together."""
    r = t.orders.select((c("o_custkey") % 50).alias("session"), ((c("o_orderkey") * 7919 % 300000) * 100).alias("offset"), (1 + c("o_orderkey") % 90).alias("len"))
    return out(view.byte_runs(r, ["session"], 1000000), session="long", run="long", first="long", last="long", chunks="long")


@query("w06_greedy_batches")
def w06(t: Tables) -> DataFrame:
    """Batches around the most urgent jobs (order-dependent: tested against a plain walk)."""
    j = t.orders.select((c("o_custkey") % 20).alias("session"), (c("o_orderkey") % 7).alias("level"), c("o_orderkey").alias("cx"), c("o_custkey").alias("cz"), c("o_totalprice").alias("score"), ((c("o_orderkey") * 7919 % 300000) * 100).alias("offset"), (1 + c("o_orderkey") % 900).alias("len"), F.when(c("o_orderkey") % 3 == 0, "fetch").otherwise("build").alias("mode"))
    return out(view.greedy_batches(j, "session"), session="long", batch="long", level="long", cx="long", cz="long")


_RES = "SELECT o_custkey % 30 AS session, o_orderkey % 7 AS level, o_orderkey AS cx, o_custkey AS cz, (1000 + o_orderkey % 5000)::BIGINT AS bytes, o_totalprice AS last_used FROM orders"


@query(
    "t05_w15_evicted",
    f"""WITH r AS ({_RES}), tot AS (SELECT session, sum(bytes) AS total FROM r GROUP BY 1), f AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY session ORDER BY last_used, level, cx, cz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WHERE level < 6 AND level <> 3)
    SELECT session, level, cx, cz FROM f JOIN tot USING (session) WHERE total > 1000000 AND total - before > 0.7 * 1000000""",
)
def t05(t: Tables) -> DataFrame:
    """The least recently used chunks, down to 70 % of the budget."""
    r = t.orders.select((c("o_custkey") % 30).alias("session"), (c("o_orderkey") % 7).alias("level"), c("o_orderkey").alias("cx"), c("o_custkey").alias("cz"), (1000 + c("o_orderkey") % 5000).alias("bytes"), c("o_totalprice").alias("last_used"))
    keep = r.filter("level = 3").select("session", *view.KEY)
    return out(view.evicted(r, ["session"], keep, 1000000.0), session="long", level="long", cx="long", cz="long")


@query("w16_revealed", "SELECT session, k FROM (SELECT o_custkey % 30 AS session, o_orderkey AS k, coalesce(sum(o_orderkey % 400) OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders) WHERE before < 20000")
def w16(t: Tables) -> DataFrame:
    r = t.orders.select((c("o_custkey") % 30).alias("session"), c("o_orderkey").alias("k"), (c("o_orderkey") % 400).alias("faces"))
    return out(view.revealed(r, ["session"], ["k"], 20000), session="long", k="long")


@query("u06_t10_warm_set", f"SELECT DISTINCT al2 AS level, ax AS cx, az AS cz FROM ({_ANC}) UNION SELECT level, cx, cz FROM directory WHERE level >= 3", ("chunk", "directory", "wish"))
def u06(t: Tables) -> DataFrame:
    return out(view.warm_set(t.wish, t.directory), level="long", cx="long", cz="long")


@query("a21_queue_states", "SELECT o_custkey % 30 AS session, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS queued, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS inflight, sum(o_orderkey % 500)::BIGINT AS bytes FROM orders GROUP BY 1")
def a21(t: Tables) -> DataFrame:
    j = t.orders.select((c("o_custkey") % 30).alias("session"), F.when(c("o_orderstatus") == "O", "queued").when(c("o_orderstatus") == "F", "inflight").otherwise("done").alias("state"), (c("o_orderkey") % 500).alias("bytes"))
    return out(view.state_totals(j, ["session"]), session="long", queued="long", inflight="long", bytes="long")


@query(
    "a14_start_view",
    "WITH s AS (SELECT sum(w * cos(radians(lat)) * cos(radians(lon))) AS x, sum(w * sin(radians(lat))) AS y, sum(w * -cos(radians(lat)) * sin(radians(lon))) AS z FROM (SELECT *, abs(size) AS w FROM place)) SELECT round(x / sqrt(x * x + y * y + z * z), 9) AS x, round(y / sqrt(x * x + y * y + z * z), 9) AS y, round(z / sqrt(x * x + y * y + z * z), 9) AS z FROM s",
    ("place",),
)
def a14(t: Tables) -> DataFrame:
    """Weighted centre on the sphere."""
    from gridspan.functions.coords import on_sphere

    d = t.place.select(F.abs("size").alias("w"), on_sphere(c("lon"), c("lat")).alias("p")).agg(*[F.sum(c("w") * c(f"p.{k}")).alias(k) for k in "xyz"])
    n = F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z"))
    return out(d.select(*[(c(k) / n).alias(k) for k in "xyz"]), x="round9", y="round9", z="round9")


# --- graphs ---------------------------------------------------------------------------------------------


@query(
    "g04_a17_cell_components",
    """WITH RECURSIVE m AS (SELECT DISTINCT x, z FROM voxel WHERE cls = 6 AND y < 2), r(x, z, label) AS (SELECT x, z, x * 1048576 + z FROM m UNION SELECT m.x, m.z, r.label FROM r JOIN m ON abs(m.x - r.x) <= 1 AND abs(m.z - r.z) <= 1 AND m.x BETWEEN r.x - 1 AND r.x + 1),
    l AS (SELECT x, z, min(label) AS label FROM r GROUP BY 1, 2) SELECT label, count(*) AS size, (max(z) - min(z) + 1) AS extent FROM l GROUP BY 1""",
    ("voxel",),
)
def g04(t: Tables) -> DataFrame:
    """Components of marked cells by eight neighbours, with size and extent."""
    m = t.voxel.filter("cls = 6 AND y < 2").select("x", "z").distinct()
    d = graph.cell_components(m, diagonal=True).groupBy("label").agg(F.count(F.lit(1)).alias("size"), (F.max("z") - F.min("z") + 1).alias("extent"))
    return out(d, label="long", size="long", extent="long")


@query("g01_o05_bridged_gaps")
def g01(t: Tables) -> DataFrame:
    """Gaps in rivers bridged nearest first (tested against a spanning-tree brute force)."""
    return out(graph.bridge_gaps(t.line_end, "river"), river="long", x0="round6", y0="round6", x1="round6", y1="round6")


@query("o08_k02_shelf_packed_pages")
def o08(t: Tables) -> DataFrame:
    """Images on shelves of pages, the tallest first (order-dependent: tested for overlap and order)."""
    s = t.part.select(c("p_partkey").alias("id"), (10 + c("p_partkey") * 37 % 300).alias("w"), (5 + c("p_size") * 4).alias("h"))
    return out(graph.shelf_pack(s), id="long", page="long", x="long", y="long")
