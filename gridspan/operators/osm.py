"""Map elements: tag classification, heights, way geometry and relation walks.

Elements are three tables: nodes (id, lon, lat), ways (id, nds, tags) and relations (id, members,
tags), with tags as map<string,string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions.text import lenient_number, truthy
from gridspan.session import use_checkpoints

# Which tags make which layer, and widths in metres by highway class.
SPARSE_LANDUSE = ["cemetery", "religious"]
VEG_LANDUSE = ["grass", "forest", "meadow", "village_green", "recreation_ground", "orchard"]
VEG_NATURAL = ["wood", "scrub", "grassland", "heath"]
VEG_LEISURE = ["park", "garden"]
FOOT = ["footway", "path", "steps", "pedestrian", "cycleway", "bridleway"]
HIGHWAY_SKIP = ["proposed", "construction", "platform", "bus_stop", "street_lamp", "crossing", "traffic_signals", "stop", "give_way", "elevator", "corridor"]
RAIL = ["rail", "subway", "light_rail", "tram"]
WIDTHS = {
    "motorway": 12.0, "trunk": 10.0, "primary": 9.0, "secondary": 7.0, "tertiary": 7.0, "residential": 5.5, "unclassified": 5.0, "living_street": 4.0, "service": 3.2, "track": 3.0,
    "pedestrian": 3.0, "footway": 1.5, "path": 1.5, "steps": 1.5, "cycleway": 2.0, "bridleway": 1.5,
}
POLES = {"highway": "street_lamp", "power": "pole", "man_made": "utility_pole"}
CENTERLINES = ["river", "stream", "canal", "tidal_channel", "rapids", "waterfall", "drain", "ditch", "brook"]
SKIP_ROLES = ["tributary", "spring", "mouth", "source", "branch", "inflow", "outflow", "label"]


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _in(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))


def is_area(nds: Column, tags: Column) -> Column:
    """A closed way is a polygon unless a linear tag says otherwise."""
    closed = (F.size(nds) >= 4) & (F.try_element_at(nds, F.lit(1)) == F.try_element_at(nds, F.lit(-1)))
    linear = tag(tags, "highway").isNotNull() | tag(tags, "railway").isNotNull() | tag(tags, "waterway").isNotNull()
    return F.coalesce(closed & (~linear | F.coalesce(tag(tags, "area") == "yes", F.lit(False))), F.lit(False))


def layers(tags: Column, area: Column) -> Column:
    """array<string>: every layer that an element feeds. ``area``: it is a polygon; else a line."""
    t = lambda k: tag(tags, k)
    yes = lambda c: F.coalesce(c, F.lit(False))
    building = yes(t("building") != "no") | t("building:part").isNotNull()
    under = yes(t("location") == "underground") | yes(F.startswith(t("layer"), F.lit("-")))
    sparse = area & _in(t("landuse"), SPARSE_LANDUSE)
    veg = area & ~sparse & (_in(t("landuse"), VEG_LANDUSE) | _in(t("natural"), VEG_NATURAL) | _in(t("leisure"), VEG_LEISURE))
    way = t("highway").isNotNull() & ~_in(t("highway"), HIGHWAY_SKIP) & ~_in(t("tunnel"), ["yes", "building_passage", "culvert"])
    foot = _in(t("highway"), FOOT) | yes(t("footway") == "sidewalk")
    line = way & ~area
    bridge = yes(t("bridge") != "no")
    rail = _in(t("railway"), RAIL) & ~area & ~yes(t("tunnel") == "yes")
    flow = t("waterway").isNotNull() & ~area & ~yes(t("waterway") == "riverbank") & ~_in(t("tunnel"), ["yes", "culvert"])
    found = {
        "building": building & area & ~under,
        "sparse": sparse,
        "veg": veg,
        "water": (area & (yes(t("natural") == "water") | yes(t("waterway") == "riverbank"))) | flow,
        "noTree": area & (yes(t("amenity") == "parking") | _in(t("leisure"), ["playground", "pitch"])),
        "foot": way & F.when(area, _in(t("highway"), FOOT)).otherwise(foot),
        "road": way & F.when(area, ~_in(t("highway"), FOOT)).otherwise(~foot),
        "bridge": (line | rail) & bridge,
        "lit": line & yes(t("lit") == "yes"),
        "sidewalk_left": line & ~foot & _in(t("sidewalk"), ["left", "both"]),
        "sidewalk_right": line & ~foot & _in(t("sidewalk"), ["right", "both"]),
        "rail": rail,
        "treerow": yes(t("natural") == "tree_row") & ~area,
    }
    named = F.array(*[F.when(rule, F.lit(name)) for name, rule in found.items()])
    return F.filter(named, lambda x: x.isNotNull())


def line_width(tags: Column) -> Column:
    """A stated width (0 counts as none), a driveway's, or that of its class."""
    stated = truthy(lenient_number(tag(tags, "width")))
    kind = tag(tags, "highway")
    by_class = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in WIDTHS.items()], F.lit(3.0))
    driveway = F.coalesce((kind == "service") & (tag(tags, "service") == "driveway"), F.lit(False))
    return F.coalesce(stated, F.when(driveway, F.lit(2.5)), by_class)


def building_height(oid: Column, tags: Column) -> Column:
    """struct(height, explicit): stated, by levels, by kind, or two or three floors by a hash of the id."""
    h, levels, kind = truthy(lenient_number(tag(tags, "height"))), truthy(lenient_number(tag(tags, "building:levels"))), tag(tags, "building")
    guess = (2 + F.pmod(F.crc32(oid.cast("binary")), F.lit(2))) * 3.0
    return F.struct(F.coalesce(h, levels * 3, F.when(kind == "apartments", 15.0), F.when(kind == "school", 9.0), guess).alias("height"), (h.isNotNull() | levels.isNotNull()).alias("explicit"))


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line): each way's nodes in order as array<struct<lon,lat>>; unknown nodes are left out, a
    way without any known node is dropped."""
    w = ways.select("id", F.posexplode("nds").alias("pos", "nd"))
    n = nodes.select(F.col("id").alias("nd"), "lon", "lat")
    got = w.join(n, "nd").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p"))
    return got.select("id", F.transform("p", lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat"))).alias("line"))


def walk_relations(roots: DataFrame, members: DataFrame, depth: int = 3) -> DataFrame:
    """(root, relation, level): relations reached from each root by sub-relation members in at most
    ``depth`` levels, each once at its first level. ``members``: (relation, kind, ref, role)."""
    subs = members.filter((F.col("kind") == "relation") & ~_in(F.col("role"), SKIP_ROLES)).select(F.col("relation").alias("parent"), "ref").distinct()
    now = roots.select("root", F.col("root").alias("relation"), F.lit(0).alias("level"))
    seen = now
    for level in range(1, depth):  # a fixed number of joins
        found = now.join(subs, now["relation"] == subs["parent"]).select("root", F.col("ref").alias("relation")).distinct()
        now = found.join(seen.select("root", "relation"), ["root", "relation"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(now)
    return seen


def member_ways(walked: DataFrame, members: DataFrame, ways: DataFrame) -> DataFrame:
    """(root, way): centre-line ways of the walked relations, without side roles, each once."""
    m = members.filter((F.col("kind") == "way") & ~_in(F.col("role"), SKIP_ROLES)).select("relation", F.col("ref").alias("way"))
    mid = ways.filter(_in(tag(F.col("tags"), "waterway"), CENTERLINES)).select(F.col("id").alias("way"))
    return walked.join(m, "relation").join(mid, "way", "left_semi").select("root", "way").distinct()


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, final): names followed through (source, target) links to the end, however long the chain, by
    doubling: every round joins the links that can go on with the table of links and is checkpointed, so
    rounds grow with the logarithm of the longest chain. A name that leads into a ring is an error."""
    use_checkpoints(names.sparkSession)
    links = aliases.filter("target IS NOT NULL").groupBy("source").agg(F.max("target").alias("target"))
    more = links.select(F.col("source").alias("target"), F.lit(True).alias("more"))
    links = links.join(more, "target", "left").select("source", "target", F.coalesce("more", F.lit(False)).alias("more")).checkpoint()
    for _ in range(links.count().bit_length()):  # 2**rounds is above the number of links
        going = links.filter("more")
        if going.isEmpty():
            break
        nxt = links.select(F.col("source").alias("target"), F.col("target").alias("far"), F.col("more").alias("on"))
        moved = going.join(nxt, "target").select("source", F.col("far").alias("target"), F.col("on").alias("more"))
        links = links.filter("NOT more").unionByName(moved).checkpoint()
    ring = links.filter("more").select(F.col("source").alias("name"))  # what still goes on has no end
    if not ring.isEmpty() and (bad := names.join(ring, "name", "left_semi").first()) is not None:
        raise RuntimeError(f"the aliases of {bad['name']!r} lead into a ring")
    return names.join(links, names["name"] == links["source"], "left").select("name", F.coalesce("target", "name").alias("final"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep_nulls: bool = False) -> DataFrame:
    """The first row of each key; with ``keep_nulls`` rows whose key is null all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_rn", F.row_number().over(w))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return d.filter((F.col("_rn") == 1) | (null if keep_nulls else F.lit(False))).drop("_rn")
