"""Queries of file readers: files are written to the shared folder from the tables, and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspan.operators import codec, grid
from gridspan.plans import q_codec
from gridspan.plans.registry import Tables, out, query
from gridspan.sources import citygml, dims, listing, osm_xml, voxel_files

c = F.col


def _folder(t: Tables, name: str) -> str:
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _text_files(t: Tables, rows: DataFrame, name: str) -> str:
    """Write (part, value): a file for each part."""
    path = _folder(t, name)
    rows.select("part", "value").repartition("part").write.partitionBy("part").text(path)
    return path


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# --- map extracts -------------------------------------------------------------------------------------------

_MAP = """SELECT 'node' AS kind, c_custkey AS id, c_nationkey + 0.5 AS a, (c_custkey % 90) + 0.25 AS b, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS tag FROM customer
    UNION ALL SELECT 'way', o_orderkey, o_custkey, o_custkey + 1, o_orderpriority FROM orders UNION ALL SELECT 'relation', n_nationkey, n_regionkey + 100, 2, n_name FROM nation"""


def _map_rows(got: dict[str, DataFrame]) -> DataFrame:
    tag = lambda k: F.coalesce(c("tags")[k], F.lit("")).alias("tag")
    members = osm_xml.relation_members(got["relations"]).groupBy(c("relation").alias("id")).agg(F.min_by("ref", "pos").alias("a"), F.count(F.lit(1)).alias("b"))
    nodes = got["nodes"].select(F.lit("node").alias("kind"), "id", c("lon").alias("a"), c("lat").alias("b"), tag("natural"))
    ways = got["ways"].select(F.lit("way").alias("kind"), "id", c("nds")[0].cast("double").alias("a"), c("nds")[1].cast("double").alias("b"), tag("highway"))
    relations = got["relations"].join(members, "id").select(F.lit("relation").alias("kind"), "id", c("a").cast("double").alias("a"), c("b").cast("double").alias("b"), tag("name"))
    return out(nodes.unionByName(ways).unionByName(relations), kind="string", id="long", a="double", b="double", tag="string")


@query("s07_map_xml", _MAP)
def s07(t: Tables) -> DataFrame:
    """A map extract in XML: nodes, ways and relations, each one pass with its own row tag."""
    k, o, n = c("c_custkey"), c("o_orderkey"), c("n_nationkey")
    tagged = F.when(k % 3 == 0, _text('<tag k="natural" v="', c("c_mktsegment"), '"/>')).otherwise("")
    nodes = t.customer.select(_text('<node id="', k, '" lat="', (k % 90) + 0.25, '" lon="', c("c_nationkey") + 0.5, '">', tagged, "</node>").alias("value"))
    ways = t.orders.select(_text('<way id="', o, '"><nd ref="', c("o_custkey"), '"/><nd ref="', c("o_custkey") + 1, '"/><tag k="highway" v="', c("o_orderpriority"), '"/></way>').alias("value"))
    relations = t.nation.select(_text('<relation id="', n, '"><member type="way" ref="', c("n_regionkey") + 100, '" role="outer"/><member type="node" ref="1" role=""/><tag k="name" v="', c("n_name"), '"/></relation>').alias("value"))
    every = nodes.unionByName(ways).unionByName(relations).groupBy(F.pmod(F.xxhash64("value"), F.lit(4)).alias("part"))
    files = every.agg(_text("<osm>", F.concat_ws("\n", F.collect_list("value")), "</osm>").alias("value"))
    return _map_rows(osm_xml.read_osm_xml(t.spark, _text_files(t, files, "map-xml") + "/*/*.txt"))


@query("s04_map_json", _MAP)
def s04(t: Tables) -> DataFrame:
    """The same tables from JSON files of elements."""
    blank = lambda v, kind: F.lit(v).cast(kind)
    tags = lambda k, v: F.create_map(F.lit(k), v)
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), blank(role, "string").alias("role"))

    def element(kind, key, lat, lon, nds, tag, members):
        return F.struct(F.lit(kind).alias("type"), key.alias("id"), lat.alias("lat"), lon.alias("lon"), nds.alias("nodes"), tag.alias("tags"), members.alias("members")).alias("e")

    no_list, no_map, no_members = blank(None, "array<long>"), blank(None, "map<string,string>"), blank(None, "array<struct<type:string,ref:long,role:string>>")
    none = blank(None, "double")
    k, n = c("c_custkey"), c("n_nationkey")
    nodes = t.customer.select((k % 4).alias("part"), element("node", k, (k % 90) + F.lit(0.25), c("c_nationkey") + F.lit(0.5), no_list, F.when(k % 3 == 0, tags("natural", c("c_mktsegment"))), no_members))
    ways = t.orders.select((c("o_orderkey") % 4).alias("part"), element("way", c("o_orderkey"), none, none, F.array("o_custkey", c("o_custkey") + 1), tags("highway", c("o_orderpriority")), no_members))
    relations = t.nation.select((n % 4).cast("long").alias("part"), element("relation", n.cast("long"), none, none, no_list, tags("name", c("n_name")), F.array(member("way", c("n_regionkey") + 100, "outer"), member("node", F.lit(1), None))))
    files = nodes.unionByName(ways).unionByName(relations).groupBy("part").agg(F.to_json(F.struct(F.collect_list("e").alias("elements"))).alias("value"))
    return _map_rows(osm_xml.read_osm_json(t.spark, _text_files(t, files, "map-json")))


# --- city models ----------------------------------------------------------------------------------------------


@query(
    "s08_s09_city_features",
    """SELECT 'TrafficArea' AS kind, 'a' || s_suppkey AS gid, (1000 + s_nationkey * 10)::VARCHAR AS function, 'lod2MultiSurface' AS lod, 1::BIGINT AS holes, (3 * (s_suppkey % 7))::DOUBLE AS h FROM supplier WHERE s_suppkey % 3 = 0
    UNION ALL SELECT 'Road', 'r' || s_suppkey, '1000', 'lod1MultiSurface', 0, (3 * (s_suppkey % 7))::DOUBLE FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT 'Building', 'b' || s_suppkey, '', 'lod1', 0, (3 * (s_suppkey % 7))::DOUBLE FROM supplier WHERE s_suppkey % 3 = 2""",
)
def s08(t: Tables) -> DataFrame:
    """Features of city-model files: a road's traffic areas or itself, buildings by level of detail."""
    k, h = c("s_suppkey"), c("s_suppkey") % 7
    ring = lambda h: _text("<gml:posList>1 2 ", h, " 1 3 ", h, " 2 3 ", h, "</gml:posList>")
    polygon = lambda inner: _text("<gml:Polygon><gml:exterior>", ring(h), "</gml:exterior>", inner, "</gml:Polygon>")
    hole = _text("<gml:interior>", ring(F.lit(0)), "</gml:interior>")
    area = _text('<tran:Road gml:id="r', k, '"><tran:trafficArea><tran:TrafficArea gml:id="a', k, '"><tran:function>', 1000 + c("s_nationkey") * 10, "</tran:function><tran:lod2MultiSurface>", polygon(hole), "</tran:lod2MultiSurface></tran:TrafficArea></tran:trafficArea></tran:Road>")
    road = _text('<tran:Road gml:id="r', k, '"><tran:function>1000</tran:function><tran:lod1MultiSurface>', polygon(""), "</tran:lod1MultiSurface></tran:Road>")
    house = _text('<bldg:Building gml:id="b', k, '"><bldg:lod1Solid>', polygon(""), "</bldg:lod1Solid></bldg:Building>")
    one = F.when(k % 3 == 0, area).when(k % 3 == 1, road).otherwise(house)
    head, tail = '<core:CityModel xmlns:core="c" xmlns:gml="g" xmlns:tran="t" xmlns:bldg="b">', "</core:CityModel>"
    files = t.supplier.groupBy(c("s_nationkey").alias("part")).agg(_text(head, F.concat_ws("", F.collect_list(one)), tail).alias("value"))
    found = citygml.read_features(t.spark, _text_files(t, files, "city") + "/*/*.txt", ["Road", "Building"])
    d = citygml.unique_features(found, ["file", "seq"]).select("kind", "gid", F.coalesce("function", F.lit("")).alias("function"), F.explode("lods").alias("lod", "polys")).withColumn("p", F.explode("polys"))
    total = F.aggregate("p.shell", F.lit(0.0), lambda a, q: a + q["h"])
    return out(d.select("kind", "gid", "function", "lod", F.size("p.holes").alias("holes"), total.alias("h")), kind="string", gid="string", function="string", lod="string", holes="long", h="double")


# --- small dimensions, layers, directories ----------------------------------------------------------------------


@query("s18_names_and_places", "SELECT 'p' || c_custkey AS id, c_name AS name, c_nationkey + 0.5 AS lat, (c_custkey % 100)::BIGINT AS x FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, pos, pos FROM nation, (SELECT 0 AS pos)")
def s18(t: Tables) -> DataFrame:
    """Validated JSON: an array of places, and names by id of which equal ones count once."""
    k = c("c_custkey")
    place = F.struct(_text("p", k).alias("id"), c("c_name").alias("name"), (c("c_nationkey") + F.lit(0.5)).alias("lat"), F.array((k % 100).cast("int"), F.lit(1)).alias("epsg6677"))
    files = t.customer.groupBy((k % 3).alias("part")).agg(F.to_json(F.collect_list(place)).alias("value"))
    places = dims.checked(dims.read_rows(t.spark, _text_files(t, files, "places"), dims.PLACES), {"an id": c("id").isNotNull(), "two numbers": F.size("epsg6677") == 2})
    name = lambda lang, v: F.struct(F.lit(lang).alias("lang"), v.alias("name"))
    listed = F.struct(_text("n", c("n_nationkey")).alias("key"), F.array(name("en", c("n_name")), name("xx", _text(" ", c("n_name"), "  ")), name("ja", F.lit(" "))).alias("value"))
    files = t.nation.groupBy(F.lit(0).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(listed))).alias("value"))
    names = dims.read_names(t.spark, _text_files(t, files, "names"))
    both = places.select("id", "name", "lat", c("epsg6677")[0].alias("x")).unionByName(names.select("id", "name", c("pos").cast("double").alias("lat"), c("pos").alias("x")))
    return out(both, id="string", name="string", lat="double", x="long")


@query("s17_k03_layer_window", "SELECT x, z, max(y)::DOUBLE AS h FROM (SELECT x * 16 AS x, z * 16 AS z, y FROM voxel) WHERE x >= 500 AND x < 1300 AND z >= 100 AND z < 900 GROUP BY 1, 2", ("voxel",))
def s17(t: Tables) -> DataFrame:
    """Layers written by supertile; a window reads only the supertiles that it needs."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    top = t.voxel.groupBy((c("x") * 16).cast("int").alias("x"), (c("z") * 16).cast("int").alias("z")).agg(F.max("y").cast("float").alias("h"))
    layers = top.select("x", "z", "h", none("float", "w"), F.lit(0).cast("smallint").alias("rc"), F.lit(0).cast("smallint").alias("rc_lod"), none("float", "bh"), none("float", "deck"), F.lit(True).alias("cover"))
    path = _folder(t, "layers")
    voxel_files.write_layers(layers, path)
    return out(voxel_files.read_layer_window(t.spark, path, 500, 1300, 100, 900).select("x", "z", "h"), x="long", z="long", h="double")


@query(
    "s19_archive_directories",
    """WITH RECURSIVE d AS (SELECT c_nationkey AS archive, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS slot, (c_custkey * 37 % 900) * (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END) AS len, 1 + c_custkey % 20 AS height FROM customer),
    s AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY slot) AS n FROM d WHERE len > 0),
    walk AS (SELECT archive, n, slot, len, height, 0::BIGINT AS off FROM s WHERE n = 1 UNION ALL SELECT s.archive, s.n, s.slot, s.len, s.height, CASE WHEN (w.off + w.len) % 4096 + s.len > 4096 THEN ((w.off + w.len) // 4096 + 1) * 4096 ELSE w.off + w.len END FROM walk w JOIN s ON s.archive = w.archive AND s.n = w.n + 1)
    SELECT archive, slot, len, height, off AS "offset" FROM walk""",
)
def s19(t: Tables) -> DataFrame:
    """Deflated directories of archives to their slots with data, and where the blobs lie."""
    k = c("c_custkey")
    d = t.customer.select(c("c_nationkey").cast("long").alias("archive"), k, (k * 37 % 900 * F.when(k % 4 == 0, 0).otherwise(1)).cast("long").alias("len"), (1 + k % 20).cast("long").alias("height"))

    def packed(table: pa.Table) -> pa.Table:
        s = table.sort_by("c_custkey")
        raw = codec.directory_bytes(s["len"].to_numpy(), s["height"].to_numpy())
        return pa.table([s["archive"].slice(0, 1), pa.array([raw], pa.binary())], names=["archive", "raw"])

    files = d.groupBy("archive").applyInArrow(packed, "archive long, raw binary")
    return out(codec.read_directories(files, "archive", "raw", 4096), archive="long", slot="long", len="long", height="long", offset="long")


# --- boxes, schedules -----------------------------------------------------------------------------------------

_SHEETS = "sheet AS (SELECT c_custkey AS box, (c_custkey % 40) * 25.0 AS x0, (c_custkey * 7 % 60) * 25.0 AS y0 FROM customer), area AS (SELECT s_suppkey AS area, (s_suppkey * 37 % 900) + 0.0 AS x0, (s_suppkey * 53 % 1300) + 0.0 AS y0, 25.0 * (1 + s_suppkey % 6) AS w FROM supplier)"


@query("s14_f09_sheets_of_areas", f"WITH {_SHEETS} SELECT box, area, (box.x0 < area.x0 + w AND area.x0 < box.x0 + 25 AND box.y0 < area.y0 + w AND area.y0 < box.y0 + 25) AS inside FROM sheet box, area WHERE box.x0 <= area.x0 + w AND area.x0 <= box.x0 + 25 AND box.y0 <= area.y0 + w AND area.y0 <= box.y0 + 25".replace("SELECT box, area,", "SELECT box.box, area.area,"))
def s14(t: Tables) -> DataFrame:
    """Sheets of an index that meet areas, edges included, and whether they overlap."""
    k, s = c("c_custkey"), c("s_suppkey")
    square = lambda d, name, x, y, w: d.select(name, x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"))
    sheets = square(t.customer, k.alias("box"), (k % 40) * 25.0, (k * 7 % 60) * 25.0, F.lit(25.0))
    areas = square(t.supplier, s.alias("area"), (s * 37 % 900) + F.lit(0.0), (s * 53 % 1300) + F.lit(0.0), 25.0 * (1 + s % 6))
    strict = grid.boxes_meeting(sheets, areas, 100.0, touching=False).withColumn("inside", F.lit(True))
    d = grid.boxes_meeting(sheets, areas, 100.0).join(strict, ["box", "area"], "left")
    return out(d.select("box", "area", F.coalesce("inside", F.lit(False)).alias("inside")), box="long", area="long", inside="boolean")


@query("o04_largest_first", "SELECT name, rank, (CASE WHEN rank % 16 < 8 THEN rank % 16 ELSE 15 - rank % 16 END) AS lane FROM (SELECT p_name || p_partkey AS name, row_number() OVER (ORDER BY p_size DESC, p_name || p_partkey) - 1 AS rank FROM part)")
def o04(t: Tables) -> DataFrame:
    """Files to eight lanes, the largest first."""
    files = t.part.select(_text(c("p_name"), c("p_partkey")).alias("name"), c("p_size").alias("size"))
    return out(listing.largest_first(files, 8).select("name", "rank", "lane"), name="string", rank="long", lane="long")


# --- the symbol stream -------------------------------------------------------------------------------------------


@query(
    "w03_c05_c08_symbols",
    f"""WITH {q_codec.TOWN}, o AS (SELECT unnest([-1, 0, 1]) AS d), w AS (SELECT x // 32 + a.d AS cx, z // 32 + b.d AS cz, x - (x // 32 + a.d) * 32 + 1 AS lx, z - (z // 32 + b.d) * 32 + 1 AS lz, y, cls FROM town, o a, o b),
    k AS (SELECT * FROM w WHERE lx BETWEEN 0 AND 33 AND lz BETWEEN 0 AND 33), own AS (SELECT DISTINCT cx, cz FROM k WHERE lx BETWEEN 1 AND 32 AND lz BETWEEN 1 AND 32),
    col AS (SELECT cx, cz, lx, lz, CASE WHEN max(y) > 32 THEN 8 WHEN max(cls) = 2 THEN 2 WHEN max(cls) = 3 THEN 3 ELSE 4 END AS p, count(CASE WHEN cls = 1 AND y < 32 THEN 1 END) AS s FROM k SEMI JOIN own USING (cx, cz) GROUP BY 1, 2, 3, 4),
    f AS (SELECT cx, cz, lx, lz, coalesce(p, 0) AS p, coalesce(s, 0) AS s FROM own CROSS JOIN (SELECT unnest(range(0, 34)) AS lx) i CROSS JOIN (SELECT unnest(range(0, 34)) AS lz) j LEFT JOIN col USING (cx, cz, lx, lz)),
    r AS (SELECT *, coalesce(lag(p) OVER row_, 9) AS l, coalesce(lead(p) OVER row_, 9) AS n, lag(s) OVER row_ AS sl FROM f WINDOW row_ AS (PARTITION BY cx, cz, lz ORDER BY lx)),
    g AS (SELECT *, coalesce(lag(p) OVER col_, 9) AS u, coalesce(lag(l) OVER col_, 9) AS d, coalesce(lag(n) OVER col_, 9) AS a, lag(s) OVER col_ AS su, lag(sl) OVER col_ AS sd FROM r WINDOW col_ AS (PARTITION BY cx, cz, lx ORDER BY lz)),
    e AS (SELECT *, coalesce(sl, su, 0) AS e1, coalesce(su, sl, 0) AS e2, CASE WHEN lx = 0 THEN coalesce(su, 0) WHEN lz = 0 THEN sl ELSE sd END AS e3 FROM g),
    v AS (SELECT *, s - greatest(least(e1 + e2 - e3, greatest(e1, e2)), least(e1, e2)) AS off FROM e),
    y AS (SELECT *, CASE WHEN off >= 0 THEN 2 * off ELSE -2 * off - 1 END AS zz FROM v)
    SELECT 0::BIGINT AS tid, (((l * 10 + u) * 2 + (d = u)::INT) * 2 + (a = u)::INT)::BIGINT AS ctx, p::BIGINT AS sym, count(*) AS n FROM y GROUP BY 2, 3
    UNION ALL SELECT 1, ((greatest(-2, least(2, e1 - e3)) + 2) * 35 + (greatest(-2, least(2, e2 - e3)) + 2) * 7 + p - 1), CASE WHEN zz < 12 THEN zz ELSE floor(log2(zz))::BIGINT + 9 END, count(*) FROM y WHERE p BETWEEN 1 AND 7 GROUP BY 2, 3""",
    ("voxel",),
)
def w03(t: Tables) -> DataFrame:
    """Patterns and surfaces of all chunks as symbols under their contexts, counted from the stream."""
    d = codec.symbol_stream(q_codec.chunks_of_town(t)).filter("tid IN (0, 1)").groupBy("tid", "ctx", "sym").agg(F.count(F.lit(1)).alias("n"))
    return out(d, tid="long", ctx="long", sym="long", n="long")
