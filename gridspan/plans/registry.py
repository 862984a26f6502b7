"""Registration of queries: a Spark function and the DuckDB SQL of the same rows.

SQL may begin with ``{voxel}`` and other names of ``FIXTURES``: common table expressions that derive
small geometric tables from the given ones, the same way in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.session import ship, use_checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name, and the derived fixtures."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)
        use_checkpoints(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SPARK_FIXTURES:
            return SPARK_FIXTURES[name](self)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


SPARK_FIXTURES: dict[str, Callable[[Tables], DataFrame]] = {}
FIXTURES: dict[str, str] = {}


def fixture(name: str, sql: str):
    def keep(f: Callable[[Tables], DataFrame]):
        SPARK_FIXTURES[name] = f
        FIXTURES[name] = f"{name} AS ({sql})"
        return f

    return keep


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """``uses``: fixtures of the SQL, in an order in which each needs only those before it."""

    def keep(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql is not None:
            head = ", ".join(FIXTURES[u] for u in uses)
            body = sql.strip()
            if head:
                rest = body[4:].lstrip() if body.upper().startswith("WITH") else None
                recursive = rest is not None and rest.upper().startswith("RECURSIVE")
                rest = rest[9:].lstrip() if recursive else rest
                body = f"WITH {'RECURSIVE ' if recursive else ''}{head}, {rest}" if rest is not None else f"WITH {head} {body}"
            ORACLES[name] = body
        return f

    return keep


def out(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns cast for comparison: name="long", "string", "double", or "round6"."""
    cols = []
    for name, kind in kinds.items():
        c = F.col(name)
        cols.append(F.round(c.cast("double"), int(kind[5:])).alias(name) if kind.startswith("round") else c.cast(kind).alias(name))
    return df.select(*cols)


# --- fixtures -------------------------------------------------------------------------------------------

#: Side of the voxel world in cells.
SIDE = 128


@fixture("voxel", f"SELECT (l_partkey % {SIDE})::BIGINT AS x, (l_suppkey * 7 % {SIDE})::BIGINT AS z, (floor(l_quantity)::BIGINT % 16) AS y, min(1 + (l_orderkey + l_linenumber) % 12)::BIGINT AS cls FROM lineitem GROUP BY 1, 2, 3")
def _voxel(t: Tables) -> DataFrame:
    """Solid cells of a world of SIDE x SIDE x 16."""
    return t.lineitem.groupBy((F.col("l_partkey") % SIDE).cast("long").alias("x"), (F.col("l_suppkey") * 7 % SIDE).cast("long").alias("z"), (F.floor("l_quantity") % 16).cast("long").alias("y")).agg(F.min(1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 12).cast("long").alias("cls"))


@fixture(
    "point",
    f"""SELECT l_orderkey * 8 + l_linenumber AS id, (l_partkey % {SIDE}) + (l_extendedprice - floor(l_extendedprice)) AS x, (l_suppkey * 7 % {SIDE}) + l_discount * 9 AS y,
    floor(l_quantity) / 4 + l_tax * 10 AS z, (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END)::BIGINT AS c, (1 + l_linenumber % 2)::BIGINT AS rn, (1 + l_orderkey % 2)::BIGINT AS nr,
    (l_partkey % 200)::BIGINT AS r, (l_orderkey % 256)::BIGINT AS g, (l_suppkey % 200)::BIGINT AS b FROM lineitem""",
)
def _point(t: Tables) -> DataFrame:
    """A point cloud: position, class (2 is ground), return number and count, colour."""
    c = F.col
    return t.lineitem.select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"),
        ((c("l_partkey") % SIDE) + (c("l_extendedprice") - F.floor("l_extendedprice"))).alias("x"),
        ((c("l_suppkey") * 7 % SIDE) + c("l_discount") * 9).alias("y"),
        (F.floor("l_quantity") / 4 + c("l_tax") * 10).alias("z"),
        F.when(c("l_returnflag") == "R", 2).otherwise(1).cast("long").alias("c"),
        (1 + c("l_linenumber") % 2).cast("long").alias("rn"),
        (1 + c("l_orderkey") % 2).cast("long").alias("nr"),
        (c("l_partkey") % 200).cast("long").alias("r"),
        (c("l_orderkey") % 256).cast("long").alias("g"),
        (c("l_suppkey") % 200).cast("long").alias("b"),
    )


@fixture("place", "SELECT s_suppkey AS id, s_name AS name, 35.5 + (s_suppkey * 37 % 400) / 1000.0::DOUBLE AS lat, 139.5 + (s_suppkey * 91 % 600) / 1000.0::DOUBLE AS lon, s_acctbal AS size, s_nationkey AS nation FROM supplier")
def _place(t: Tables) -> DataFrame:
    """Points on the globe."""
    c = F.col
    return t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), (35.5 + (c("s_suppkey") * 37 % 400) / 1000.0).alias("lat"), (139.5 + (c("s_suppkey") * 91 % 600) / 1000.0).alias("lon"), c("s_acctbal").alias("size"), c("s_nationkey").alias("nation"))


@fixture("chunk", "SELECT DISTINCT level, cx, cz FROM (SELECT o_orderkey * 37 % 256 AS x, o_custkey * 11 % 200 AS z, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P') t, (SELECT unnest(range(0, 7))::BIGINT AS level) l, LATERAL (SELECT (x >> level)::BIGINT AS cx, (z >> level)::BIGINT AS cz) k WHERE level > 0 OR p < '4'")
def _chunk(t: Tables) -> DataFrame:
    """Which chunks of a seven-level quadtree exist (some level-0 chunks are absent)."""
    c = F.col
    base = t.orders.filter(c("o_orderstatus") != "P").select((c("o_orderkey") * 37 % 256).alias("x"), (c("o_custkey") * 11 % 200).alias("z"), c("o_orderpriority").alias("p"))
    at = base.select("x", "z", "p", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("level"))
    there = at.filter((c("level") > 0) | (c("p") < "4"))
    return there.select(c("level").cast("long").alias("level"), F.expr("shiftright(x, level)").alias("cx"), F.expr("shiftright(z, level)").alias("cz")).distinct()


@fixture("directory", "SELECT level, cx, cz, (1 + (level * 4099 + cx * 37 + cz * 101) % 4096)::BIGINT AS len, (1 + (cx * 5 + cz * 3 + level) % 20)::BIGINT AS height FROM chunk")
def _directory(t: Tables) -> DataFrame:
    c = F.col
    return t.chunk.select("level", "cx", "cz", (1 + (c("level") * 4099 + c("cx") * 37 + c("cz") * 101) % 4096).alias("len"), (1 + (c("cx") * 5 + c("cz") * 3 + c("level")) % 20).alias("height"))


@fixture("line_end", "SELECT o_custkey AS river, o_orderkey AS line, (o_orderkey * 7919 % 3600) / 200.0::DOUBLE AS lon0, (o_orderkey * 104729 % 1700) / 200.0::DOUBLE AS lat0, (o_orderkey * 7919 % 3600) / 200.0::DOUBLE + (o_orderkey % 11) / 10.0::DOUBLE AS lon1, (o_orderkey * 104729 % 1700) / 200.0::DOUBLE + (o_orderkey % 7) / 10.0::DOUBLE AS lat1 FROM orders")
def _line_end(t: Tables) -> DataFrame:
    """Polylines by their two ends, grouped by river."""
    c = F.col
    lon, lat = (c("o_orderkey") * 7919 % 3600) / 200.0, (c("o_orderkey") * 104729 % 1700) / 200.0
    return t.orders.select(c("o_custkey").alias("river"), c("o_orderkey").alias("line"), lon.alias("lon0"), lat.alias("lat0"), (lon + (c("o_orderkey") % 11) / 10.0).alias("lon1"), (lat + (c("o_orderkey") % 7) / 10.0).alias("lat1"))
