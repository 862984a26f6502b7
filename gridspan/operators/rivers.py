"""Ranking rivers and assembling their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions import text
from gridspan.functions.coords import unwrapped
from gridspan.operators import graph, osm

c = F.col


def with_ids(rows: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (row, name, length_km, titles) with qids: titles decoded, followed through (source,
    target) aliases and looked up in (title, qid), in order, those without an id left out."""
    t = rows.select("row", F.posexplode("titles").alias("pos", "title")).withColumn("name", text.unquoted(c("title")))
    final = osm.resolve_aliases(t.select("name").distinct(), aliases)
    j = t.join(final, "name").join(ids.select(c("title").alias("final"), "qid"), "final")
    q = j.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "qid"))), lambda s: s["qid"]).alias("qids"))
    return rows.join(q, "row", "left").withColumn("qids", F.coalesce("qids", F.array().cast("array<string>")))


def topped_up(rivers: DataFrame, more: DataFrame, need: Column | int) -> DataFrame:
    """``rivers`` (row, name, length_km, titles, qids) and the ``need`` longest of ``more`` (qid, name,
    length) whose id none of them has; an id that is listed twice counts once."""
    have = rivers.select(F.explode("qids").alias("qid")).distinct()
    extra = osm.first_per_key(more.join(have, "qid", "left_anti"), ["qid"], ["name"]).orderBy(c("length").desc(), "qid").limit(need)
    last = F.lit(1 << 40)
    rank = F.row_number().over(Window.orderBy(c("length").desc(), "qid"))  # of at most ``need`` rows
    rows = extra.withColumn("row", last + rank).select("row", "name", F.rint("length").cast("long").alias("length_km"), F.array().cast("array<string>").alias("titles"), F.array("qid").alias("qids"))
    return rivers.select("row", "name", "length_km", "titles", "qids").unionByName(rows)


def ranked(rivers: DataFrame, n: int) -> DataFrame:
    """(rank, id, name, length_km, titles, qids) of the n longest; ties keep their order."""
    top = rivers.orderBy(c("length_km").desc(), "row").limit(n)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(c("length_km").desc(), "row")))  # of n rows
    return r.select("rank", F.concat(F.lpad(c("rank").cast("string"), 3, "0"), F.lit("-"), text.slug(c("name"))).alias("id"), "name", "length_km", "titles", "qids")


def unwrapped_lines(points: DataFrame) -> DataFrame:
    """(river, line, seq, lon, lat) with longitudes moved east where a river spans the antimeridian."""
    g = points.groupBy("river").agg(F.min("lon").alias("_lo"), F.max("lon").alias("_hi"))
    return points.join(g, "river").withColumn("lon", unwrapped(c("lon"), c("_lo"), c("_hi"))).drop("_lo", "_hi")


def line_ends(points: DataFrame) -> DataFrame:
    """(river, line, lon0, lat0, lon1, lat1)."""
    g = points.groupBy("river", "line").agg(F.min_by(F.struct("lon", "lat"), "seq").alias("a"), F.max_by(F.struct("lon", "lat"), "seq").alias("b"))
    return g.select("river", "line", c("a.lon").alias("lon0"), c("a.lat").alias("lat0"), c("b.lon").alias("lon1"), c("b.lat").alias("lat1"))


def pixels(points: DataFrame, res: float = 0.01, margin: int = 4, limit: float = 500.0) -> dict[str, DataFrame]:
    """``pages``: (river, west, south, east, north, w, h) and ``ink``: (river, x, z) of rivers' lines with
    their bridges, scaled so that each fits a page."""
    p = unwrapped_lines(points)
    bridges = graph.bridge_gaps(line_ends(p), "river")
    w = Window.partitionBy("river", "line").orderBy("seq")
    own = p.withColumn("x1", F.lead("lon").over(w)).withColumn("y1", F.lead("lat").over(w)).filter("x1 IS NOT NULL").select("river", c("lon").alias("x0"), c("lat").alias("y0"), "x1", "y1")
    seg = own.unionByName(bridges)
    b = p.groupBy("river").agg(F.min("lon").alias("lo"), F.max("lon").alias("hi"), F.min("lat").alias("la"), F.max("lat").alias("lb"))
    b = b.withColumn("dx", res / F.greatest(F.cos(F.radians((c("la") + c("lb")) / 2)), F.lit(0.25)))
    b = b.withColumn("k", F.greatest(F.lit(1.0), (c("hi") - c("lo")) / c("dx") / limit, (c("lb") - c("la")) / res / limit))
    b = b.withColumn("dx", c("dx") * c("k")).withColumn("dy", res * c("k"))
    b = b.withColumn("w", F.ceil((c("hi") - c("lo")) / c("dx")) + 1 + 2 * margin).withColumn("h", F.ceil((c("lb") - c("la")) / c("dy")) + 1 + 2 * margin)
    b = b.withColumn("west", c("lo") - margin * c("dx")).withColumn("north", c("lb") + margin * c("dy"))
    px = lambda v: F.floor((c(v) - c("west")) / c("dx")).cast("double")
    py = lambda v: F.floor((c("north") - c(v)) / c("dy")).cast("double")
    ink = seg.join(b, "river").select("river", px("x0").alias("x0"), py("y0").alias("z0"), px("x1").alias("x1"), py("y1").alias("z1"))
    from gridspan.operators.grid import line_cells

    pages = b.select("river", "west", (c("north") - c("h") * c("dy")).alias("south"), (c("west") + c("w") * c("dx")).alias("east"), "north", "w", "h")
    return {"pages": pages, "ink": line_cells(ink, "river")}
