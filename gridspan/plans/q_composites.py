"""Queries of whole chains."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.operators import rivers
from gridspan.plans import composites, q_grid
from gridspan.plans.registry import Tables, out, query

c = F.col


def _shared(t: Tables) -> str:
    """A folder that driver and executors share."""
    return f"{t.spark.sparkContext.getCheckpointDir()}/gridspan-{uuid.uuid4().hex}"


_COMPOSED = q_grid.ORACLE_COMPOSED_CELLS


@query(
    "k05_built_map",
    f"""WITH {_COMPOSED}, cell AS (SELECT x, y, z, cls FROM e WHERE rn = 1), o AS (SELECT unnest([-1, 0, 1]) AS d), wn AS (SELECT x // 32 + a.d AS cx, z // 32 + b.d AS cz, x - (x // 32 + a.d) * 32 + 1 AS lx, z - (z // 32 + b.d) * 32 + 1 AS lz, y, cls FROM cell, o a, o b),
    kk AS (SELECT * FROM wn WHERE lx BETWEEN 0 AND 33 AND lz BETWEEN 0 AND 33), own AS (SELECT DISTINCT cx, cz FROM kk WHERE lx BETWEEN 1 AND 32 AND lz BETWEEN 1 AND 32)
    SELECT cx, cz, count(*) AS cells, sum((lx * 40 + lz) * cls + y)::BIGINT AS mixed FROM kk SEMI JOIN own USING (cx, cz) GROUP BY 1, 2""",
)
def k05(t: Tables) -> DataFrame:
    """Tiles merged, composed, pooled, cut, trained, coded, written as an archive, and opened again."""
    from gridspan.operators import grid

    tiles = q_grid._tiles(t)
    m = grid.merged_tiles(tiles)
    spans = m.filter("bh IS NULL").select("x", "z", F.lit(10).alias("y0"), (12 + c("x") % 3).alias("y1"), (6 + c("z") % 2).alias("cls"))
    path = _shared(t)
    composites.build_map(tiles, spans, path, levels=1)
    cells = composites.open_chunks(t.spark, path)
    d = cells.groupBy("cx", "cz").agg(F.count(F.lit(1)).alias("cells"), F.sum((c("lx") * 40 + c("lz")) * c("cls") + c("y")).alias("mixed"))
    return out(d, cx="long", cz="long", cells="long", mixed="long")


@query(
    "u04_multipolygon_cells",
    "WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 13 % 100) AS x0, (s_suppkey * 29 % 100) AS z0, 6 + s_suppkey % 9 AS w, 5 + s_suppkey % 7 AS h FROM supplier) SELECT id, x, z FROM p, LATERAL (SELECT unnest(range(x0, x0 + w)) AS x) a, LATERAL (SELECT unnest(range(z0, z0 + h)) AS z) b WHERE NOT (x >= x0 + 2 AND x < x0 + 4 AND z >= z0 + 1 AND z < z0 + 3)",
)
def u04(t: Tables) -> DataFrame:
    """Outer rings less inner ones."""
    k = c("s_suppkey")
    box = lambda x0, z0, x1, z1: F.array(*[F.struct(x.cast("double").alias("x"), z.cast("double").alias("z")) for x, z in ((x0, z0), (x1, z0), (x1, z1), (x0, z1), (x0, z0))])
    x, z = k * 13 % 100, k * 29 % 100
    s = t.supplier.select(k.alias("id"), F.lit("outer").alias("role"), box(x, z, x + 6 + k % 9, z + 5 + k % 7).alias("ring"))
    h = t.supplier.select(k.alias("id"), F.lit("inner").alias("role"), box(x + 2, z + 1, x + 4, z + 3).alias("ring"))
    return out(composites.multipolygon_cells(s.unionByName(h)), id="long", x="long", z="long")


@query(
    "rivers_ranked",
    """WITH r AS (SELECT p_partkey AS row, p_name AS name, (p_size * 100)::BIGINT AS km, 'T' || (p_partkey % 700) AS title FROM part), q AS (SELECT *, CASE WHEN p_k < 500 THEN 'Q' || p_k END AS qid FROM (SELECT *, CASE WHEN substr(title, 2)::INT % 5 = 0 THEN substr(title, 2)::INT + 1 ELSE substr(title, 2)::INT END AS p_k FROM r)),
    more AS (SELECT 'Q' || (s_suppkey * 9) AS qid, s_name AS name, 900.0 + s_suppkey AS len FROM supplier), t AS (SELECT * FROM more WHERE qid NOT IN (SELECT qid FROM q WHERE qid IS NOT NULL) ORDER BY len DESC, qid LIMIT 20),
    a AS (SELECT row, name, km, coalesce(qid, '') AS qids FROM q UNION ALL SELECT 1099511627776 + row_number() OVER (ORDER BY len DESC, qid), name, round_even(len, 0)::BIGINT, qid FROM t)
    SELECT row_number() OVER (ORDER BY km DESC, row) AS rank, name, km AS length_km, qids FROM a QUALIFY rank <= 300""",
)
def rivers_ranked(t: Tables) -> DataFrame:
    """Titles resolved through redirects, topped up by the longest that are new, sorted and ranked."""
    k = c("p_partkey")
    rows = t.part.select(k.alias("row"), c("p_name").alias("name"), (c("p_size") * 100).cast("long").alias("length_km"), F.array(F.concat(F.lit("T"), (k % 700).cast("string"))).alias("titles"))
    n = t.spark.range(701)
    title = lambda v: F.concat(F.lit("T"), v.cast("string"))
    aliases = n.filter("id % 5 = 0").select(title(c("id")).alias("source"), title(c("id") + 1).alias("target"))
    ids = n.filter("id < 500 AND id % 5 <> 0").select(title(c("id")).alias("title"), F.concat(F.lit("Q"), c("id").cast("string")).alias("qid"))
    more = t.supplier.select(F.concat(F.lit("Q"), (c("s_suppkey") * 9).cast("string")).alias("qid"), c("s_name").alias("name"), (900.0 + c("s_suppkey")).alias("length"))
    d = rivers.ranked(rivers.topped_up(rivers.with_ids(rows, aliases, ids), more, 20), 300)
    return out(d.select("rank", "name", "length_km", F.concat_ws("|", "qids").alias("qids")), rank="long", name="string", length_km="long", qids="string")


@query("t02_flight_demand")
def t02(t: Tables) -> DataFrame:
    """All that camera paths will want: 41 samples each, selected, with ancestors, by urgency."""
    k = c("s_suppkey")
    f = t.supplier.select(k.alias("flight"), (k * 397 % 6000).cast("double").alias("x0"), (k * 211 % 5000).cast("double").alias("z0"), F.lit(0.3).alias("zoom0"), (k * 719 % 6000).cast("double").alias("x1"), (k * 577 % 5000).cast("double").alias("z1"), F.lit(0.5).alias("zoom1"))
    return out(composites.flight_demand(f, t.directory), flight="long", level="long", cx="long", cz="long", score="round3")


@query("lidar_voxels")
def lidar(t: Tables) -> DataFrame:
    """An aerial cloud and masks to voxels (tested on a made scene)."""
    m = t.point.select(F.floor("x").alias("x"), F.floor("y").alias("z")).distinct()
    k = (c("x") * 7 + c("z") * 3) % 10
    m = m.select("x", "z", (k < 3).alias("building"), (k == 4).alias("road"), (k == 5).alias("sidewalk"), (k == 6).alias("water"))
    return out(composites.lidar_voxels(t.point, m), x="long", y="long", z="long", cls="long")
