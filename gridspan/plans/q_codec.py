"""Queries of the codec and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.operators import codec, grid
from gridspan.plans.registry import Tables, out, query

c = F.col

_RUNS = """g AS (SELECT x, z, y, cls, y - coalesce(lag(y) OVER w, -1) - 1 AS gap, lag(cls) OVER w AS pc FROM voxel WINDOW w AS (PARTITION BY x, z ORDER BY y)),
    n AS (SELECT *, sum(CASE WHEN gap > 0 OR pc IS NULL OR pc <> cls THEN 1 ELSE 0 END) OVER (PARTITION BY x, z ORDER BY y) AS run FROM g),
    s AS (SELECT x, z, run, min(y) AS y, max(cls) AS cls, count(*) AS len, max(gap) AS gap FROM n GROUP BY 1, 2, 3),
    r AS (SELECT x, z, y, cls, len FROM s UNION ALL SELECT x, z, y - gap, 0, gap FROM s WHERE gap > 0)"""


@query("w02_column_runs", f"WITH {_RUNS} SELECT x, z, row_number() OVER (PARTITION BY x, z ORDER BY y) - 1 AS pos, y, cls, len FROM r", ("voxel",))
def w02(t: Tables) -> DataFrame:
    """Runs of every column from the floor up, air between included."""
    return out(codec.column_runs(t.voxel, ["x", "z"]), x="long", z="long", pos="long", y="long", cls="long", len="long")


@query(
    "c04_column_patterns",
    f"""WITH flat AS (SELECT 1), v2 AS (SELECT x, z, y, CASE WHEN y < 3 THEN 1 WHEN y = 3 AND (x + z) % 4 = 0 THEN 2 WHEN y = 3 AND (x + z) % 4 = 1 THEN 8 WHEN y < 7 THEN 4 WHEN y = 7 THEN 5 ELSE 6 END AS cls FROM (SELECT DISTINCT x, z FROM voxel), (SELECT unnest(range(0, 9)) AS y) WHERE y < 3 + (x * 5 + z) % 7),
    {_RUNS.replace("FROM voxel", "FROM v2")}, a AS (SELECT x, z, string_agg(cls::VARCHAR, ',' ORDER BY y) AS k, list(len ORDER BY y) AS l FROM r GROUP BY 1, 2)
    SELECT CASE WHEN k = '1' THEN 1 WHEN k = '1,2' AND l[2] = 1 THEN 2 WHEN k = '1,3' AND l[2] = 1 THEN 3 WHEN k = '1,4,5' AND l[3] = 1 THEN 4 WHEN k = '1,8' AND l[2] = 1 THEN 5 WHEN k = '1,4' THEN 6 WHEN k = '1,5' AND l[2] = 1 THEN 7 ELSE 8 END::BIGINT AS pattern, count(*) AS n FROM a GROUP BY 1""",
    ("voxel",),
)
def c04(t: Tables) -> DataFrame:
    """Columns by the pattern of their runs."""
    k = (c("x") + c("z")) % 4
    d = t.voxel.select("x", "z").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), (2 + (c("x") * 5 + c("z")) % 7).cast("long"))))
    cls = F.when(c("y") < 3, 1).when((c("y") == 3) & (k == 0), 2).when((c("y") == 3) & (k == 1), 8).when(c("y") < 7, 4).when(c("y") == 7, 5).otherwise(6)
    runs = codec.column_runs(d.withColumn("cls", cls), ["x", "z"])
    a = runs.groupBy("x", "z").agg(F.array_sort(F.collect_list(F.struct("pos", "cls", "len"))).alias("r"))
    p = codec.pattern_of(F.transform("r", lambda s: s["cls"]), F.transform("r", lambda s: s["len"]))
    return out(a.groupBy(p.alias("pattern")).agg(F.count(F.lit(1)).alias("n")), pattern="long", n="long")


@query("a11_pooled_symbol_counts", "SELECT least(l_linenumber - 1, 4)::BIGINT AS grp, l_suppkey % 7 AS tid, l_partkey % 13 AS ctx, (floor(l_quantity)::BIGINT % 9) AS sym, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4")
def a11(t: Tables) -> DataFrame:
    """Symbol counts pooled by level group: partial, then final sums."""
    n = t.lineitem.groupBy((c("l_linenumber") - 1).alias("level"), (c("l_suppkey") % 7).alias("tid"), (c("l_partkey") % 13).alias("ctx"), (F.floor("l_quantity") % 9).alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    return out(codec.pool_counts(n), grp="long", tid="long", ctx="long", sym="long", n="long")


def _counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((c("l_linenumber") % 5).alias("grp"), F.lit(1).alias("tid"), (c("l_partkey") % 175).alias("ctx"), (F.floor("l_quantity") % 25).alias("sym")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a12_scaled_tables",
    "SELECT (l_linenumber % 5)::BIGINT AS grp, l_partkey % 175 AS ctx, 4096::BIGINT AS total, 25::BIGINT AS symbols, true AS positive FROM lineitem GROUP BY 1, 2",
)
def a12(t: Tables) -> DataFrame:
    """Counts to frequencies of sum 4,096, none below 1 (the exact values are unit-tested)."""
    m = codec.model_table(_counts(t))
    d = m.groupBy("grp", "ctx").agg(F.sum("freq").alias("total"), F.count(F.lit(1)).alias("symbols"), F.bool_and(c("freq") >= 1).alias("positive"))
    return out(d, grp="long", ctx="long", total="long", symbols="long", positive="boolean")


@query("w12_cumulative_tables", "SELECT l_suppkey AS ctx, sym, n, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM (SELECT l_suppkey, l_linenumber::BIGINT AS sym, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def w12(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(c("l_suppkey").alias("ctx"), c("l_linenumber").alias("sym")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("ctx").orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    return out(n.withColumn("cum", F.coalesce(F.sum("n").over(w), F.lit(0))), ctx="long", sym="long", n="long", cum="long")


def chunks_of_town(t: Tables) -> DataFrame:
    """Chunks of a plausible small town: ground, streets, houses."""
    d = t.voxel.select("x", "z").distinct()
    h = 3 + F.floor((c("x") + c("z")) / 24)
    top = F.when((c("x") % 8 < 5) & (c("z") % 8 < 5), h + 3 + (F.floor(c("x") / 8) + F.floor(c("z") / 8)) % 4).otherwise(h)
    d = d.withColumn("h", h).withColumn("top", top).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), c("top").cast("long"))))
    cls = F.when(c("y") < c("h"), 1).when(c("top") == c("h"), F.when(c("x") % 8 == 6, 2).otherwise(3)).when(c("y") == c("top"), 5).otherwise(4)
    v = d.select("x", "y", "z", cls.cast("long").alias("cls"), F.lit(0).alias("level"))
    odd = t.voxel.filter("y > 12 AND cls = 6").select("x", (c("y") + 20).alias("y"), "z", "cls", F.lit(0).alias("level"))
    return codec.chunk_columns(grid.chunk_windows(v.unionByName(odd)))


TOWN = """town AS (SELECT x, y, z, CASE WHEN y < h THEN 1 WHEN top = h THEN CASE WHEN x % 8 = 6 THEN 2 ELSE 3 END WHEN y = top THEN 5 ELSE 4 END AS cls FROM (SELECT x, z, h, CASE WHEN x % 8 < 5 AND z % 8 < 5 THEN h + 3 + (x // 8 + z // 8) % 4 ELSE h END AS top FROM (SELECT DISTINCT x, z, 3 + (x + z) // 24 AS h FROM voxel)), LATERAL (SELECT unnest(range(0, top + 1)) AS y) k UNION ALL SELECT x, y + 20, z, cls FROM voxel WHERE y > 12 AND cls = 6)"""


@query(
    "c06_c07_codec_round_trip",
    f"""WITH {TOWN}, o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT x // 32 + a.d AS cx, z // 32 + b.d AS cz, x - (x // 32 + a.d) * 32 + 1 AS lx, z - (z // 32 + b.d) * 32 + 1 AS lz, y, cls FROM town, o a, o b),
    k AS (SELECT * FROM w WHERE lx BETWEEN 0 AND 33 AND lz BETWEEN 0 AND 33), own AS (SELECT DISTINCT cx, cz FROM k WHERE lx BETWEEN 1 AND 32 AND lz BETWEEN 1 AND 32)
    SELECT cx, cz, count(*) AS cells, sum((lx * 40 + lz) * cls + y)::BIGINT AS mixed FROM k SEMI JOIN own USING (cx, cz) GROUP BY 1, 2""",
    ("voxel",),
)
def c06(t: Tables) -> DataFrame:
    """Chunks to symbols, trained tables, bytes and back to cells (w03, c05, c08): the cells are compared."""
    chunks = chunks_of_town(t).checkpoint()  # read twice: to train, then to code
    model = codec.Model.from_bytes(codec.read_model(codec.model_table(codec.pool_counts(codec.symbol_counts(chunks)))).to_bytes())
    cells = codec.decoded(codec.encoded(chunks, model), model)
    d = cells.groupBy("cx", "cz").agg(F.count(F.lit(1)).alias("cells"), F.sum((c("lx") * 40 + c("lz")) * c("cls") + c("y")).alias("mixed"))
    return out(d, cx="long", cz="long", cells="long", mixed="long")


@query("a19_bytes_by_level", "SELECT level, count(*) AS chunks, sum(len)::BIGINT AS bytes, max(height) AS height FROM directory GROUP BY 1", ("chunk", "directory"))
def a19(t: Tables) -> DataFrame:
    return out(t.directory.groupBy("level").agg(F.count(F.lit(1)).alias("chunks"), F.sum("len").alias("bytes"), F.max("height").alias("height")), level="long", chunks="long", bytes="long", height="long")


_SPREAD = " | ".join(f"((({{v}} >> {b}) & 1) << {2 * b})" for b in range(10))


def _morton(x: str, z: str) -> str:
    return f"(({_SPREAD.format(v=x)}) | (({_SPREAD.format(v=z)}) << 1))"


_SLOT = f"""slot AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN level >= 5 THEN 0 ELSE 1 END, CASE WHEN level >= 5 THEN 0 ELSE {_morton("(cx >> greatest(4 - level, 0)::INT)", "(cz >> greatest(4 - level, 0)::INT)")} END, -level, CASE WHEN level >= 5 THEN {_morton("cx", "cz")} ELSE {_morton("(cx - ((cx >> greatest(4 - level, 0)::INT) << greatest(4 - level, 0)::INT))", "(cz - ((cz >> greatest(4 - level, 0)::INT) << greatest(4 - level, 0)::INT))")} END) - 1 AS slot
    FROM directory)"""


def _slots(t: Tables) -> DataFrame:
    d = t.directory
    w = Window.orderBy(codec.slot_key(c("level"), c("cx"), c("cz")))
    return d.withColumn("slot", F.row_number().over(w) - 1)


@query("o02_slot_order", f"WITH {_SLOT} SELECT slot, level, cx, cz FROM slot", ("chunk", "directory"))
def o02(t: Tables) -> DataFrame:
    """Chunks along the file: supertiles on a Morton curve, coarse to fine in each."""
    return out(_slots(t), slot="long", level="long", cx="long", cz="long")


@query(
    "w04_k05_shard_offsets",
    f"""WITH RECURSIVE {_SLOT}, walk AS (SELECT slot, len, 0::BIGINT AS off FROM slot WHERE slot = 0 UNION ALL SELECT s.slot, s.len, CASE WHEN (w.off + w.len) % 65536 + s.len > 65536 THEN ((w.off + w.len) // 65536 + 1) * 65536 ELSE w.off + w.len END FROM walk w JOIN slot s ON s.slot = w.slot + 1)
    SELECT slot, len, off AS "offset", off // 65536 AS shard FROM walk""",
    ("chunk", "directory"),
)
def w04(t: Tables) -> DataFrame:
    """Positions of blobs; one that would straddle a shard's end begins the next (s19)."""
    d = codec.with_offsets(_slots(t).select("slot", "len"), "slot", "len", 65536)
    return out(d.withColumn("shard", F.floor(c("offset") / 65536)), slot="long", len="long", offset="long", shard="long")
