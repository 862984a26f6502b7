"""Queries of the relational core: joins, windows, sets, ranking, and element tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspan.functions import text
from gridspan.operators import osm
from gridspan.plans.registry import Tables, out, query

c = F.col


@query(
    "j01_ordered_ids_of_titles",
    """WITH r AS (SELECT c_custkey AS river, [ (c_custkey * 3) % 500, (c_custkey * 7) % 500, (c_custkey * 11) % 500 ] AS titles FROM customer), e AS (SELECT river, unnest(titles) AS title, generate_subscripts(titles, 1) AS pos FROM r)
    SELECT river, string_agg(s_name, '|' ORDER BY pos) AS ids FROM e JOIN supplier ON s_suppkey = title GROUP BY river""",
)
def j01(t: Tables) -> DataFrame:
    """Titles looked up in order; those without an id are left out."""
    k = c("c_custkey")
    e = t.customer.select(k.alias("river"), F.posexplode(F.array(k * 3 % 500, k * 7 % 500, k * 11 % 500)).alias("pos", "title"))
    j = e.join(t.supplier.select(c("s_suppkey").alias("title"), "s_name"), "title").groupBy("river").agg(F.array_sort(F.collect_list(F.struct("pos", "s_name"))).alias("l"))
    return out(j.select("river", F.concat_ws("|", F.transform("l", lambda s: s["s_name"])).alias("ids")), river="long", ids="string")


@query(
    "j02_s03_top_up",
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS size FROM customer WHERE c_acctbal < 5000 AND c_acctbal >= 1000 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) ORDER BY c_acctbal DESC, c_custkey LIMIT 60",
)
def j02(t: Tables) -> DataFrame:
    """The largest below a bound that are not there yet: filter, anti join, top k."""
    have = t.orders.filter(c("o_totalprice") > 300000).select(c("o_custkey").alias("c_custkey"))
    d = t.customer.filter((c("c_acctbal") < 5000) & (c("c_acctbal") >= 1000)).join(have, "c_custkey", "left_anti").orderBy(c("c_acctbal").desc(), "c_custkey").limit(60)
    return out(d.select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("size")), id="long", name="string", size="double")


@query(
    "j03_way_geometry",
    """WITH w AS (SELECT o_custkey AS id, list(o_orderkey * 3 % 400 ORDER BY o_orderkey) AS nds FROM orders GROUP BY o_custkey), e AS (SELECT id, unnest(nds) AS nd, generate_subscripts(nds, 1) AS pos FROM w)
    SELECT e.id, string_agg(n.id::VARCHAR, ',' ORDER BY pos) AS line, count(*) AS n FROM e JOIN place n ON n.id = e.nd GROUP BY e.id""",
    ("place",),
)
def j03(t: Tables) -> DataFrame:
    """Ways to polylines: nodes joined by id, in order, unknown ones left out."""
    w = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey"))), lambda s: s["o_orderkey"] * 3 % 400).alias("nds"))
    n = t.place.select("id", c("id").cast("double").alias("lon"), c("lat"))
    d = osm.way_lines(w, n)
    return out(d.select("id", F.concat_ws(",", F.transform("line", lambda p: p["lon"].cast("long").cast("string"))).alias("line"), F.size("line").alias("n")), id="long", line="string", n="long")


@query(
    "j04_g03_relation_walk",
    """WITH RECURSIVE m AS (SELECT o_custkey AS relation, CASE WHEN o_orderkey % 2 = 0 THEN 'way' ELSE 'relation' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey * 13 % 300 END AS ref, CASE WHEN o_orderkey % 9 = 0 THEN 'tributary' ELSE '' END AS role FROM orders),
    walk AS (SELECT DISTINCT c_custkey AS root, c_custkey AS relation, 0 AS level FROM customer UNION ALL SELECT DISTINCT root, ref, level + 1 FROM walk JOIN m USING (relation) WHERE level < 2 AND kind = 'relation' AND role <> 'tributary'),
    rel AS (SELECT root, relation, min(level) AS level FROM walk GROUP BY 1, 2)
    SELECT root, count(DISTINCT relation) AS relations, count(DISTINCT CASE WHEN kind = 'way' AND role <> 'tributary' AND ref % 6 <> 4 THEN ref END) AS ways FROM rel LEFT JOIN m USING (relation) GROUP BY root""",
)
def j04(t: Tables) -> DataFrame:
    """Three levels of sub-relations without repeats, then their centre-line ways."""
    k = c("o_orderkey")
    m = t.orders.select(c("o_custkey").alias("relation"), F.when(k % 2 == 0, "way").otherwise("relation").alias("kind"), F.when(k % 2 == 0, k).otherwise(k * 13 % 300).alias("ref"), F.when(k % 9 == 0, "tributary").otherwise("").alias("role"))
    roots = t.customer.select(c("c_custkey").alias("root"))
    walked = osm.walk_relations(roots, m)
    ways = t.orders.select(k.alias("id"), F.create_map(F.lit("waterway"), F.when(k % 6 == 4, "dam").otherwise("river")).alias("tags"))
    n = osm.member_ways(walked, m, ways).groupBy("root").agg(F.count(F.lit(1)).alias("ways"))
    d = walked.groupBy("root").agg(F.count(F.lit(1)).alias("relations")).join(n, "root", "left").na.fill(0, ["ways"])
    return out(d, root="long", relations="long", ways="long")


@query("j05_names_of_places", "SELECT n_nationkey::BIGINT AS id, n_name AS name, r_name AS region, s_name AS first_place FROM nation LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON s_nationkey = n_nationkey")
def j05(t: Tables) -> DataFrame:
    """Left joins to small dimensions; Spark broadcasts them by their size."""
    s = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("first_place"))
    n = t.nation
    d = n.join(t.region, n["n_regionkey"] == c("r_regionkey"), "left").join(s, n["n_nationkey"] == s["s_nationkey"], "left")
    return out(d.select(c("n_nationkey").alias("id"), c("n_name").alias("name"), c("r_name").alias("region"), "first_place"), id="long", name="string", region="string", first_place="string")


@query("j09_files_of_meshes", "SELECT p_brand AS kind, (p_partkey % 50) AS mesh, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS files, count(*) AS n FROM part GROUP BY 1, 2")
def j09(t: Tables) -> DataFrame:
    """A multimap from (kind, mesh) to files."""
    d = t.part.groupBy(c("p_brand").alias("kind"), (c("p_partkey") % 50).alias("mesh")).agg(F.array_sort(F.collect_list("p_partkey")).alias("l"))
    return out(d.select("kind", "mesh", F.concat_ws(",", F.transform("l", lambda x: x.cast("string"))).alias("files"), F.size("l").alias("n")), kind="string", mesh="long", files="string", n="long")


_LISTING = "SELECT (o_orderkey % 900) * 10 AS size, (o_orderkey % 900) * 4 AS comp, lpad((o_custkey % 97)::VARCHAR, 8, '0') AS crc, CASE WHEN o_orderkey % 5 = 0 THEN 'doc/read me.txt' ELSE 'udx/' || (CASE o_orderkey % 4 WHEN 0 THEN 'bldg' WHEN 1 THEN 'tran' WHEN 2 THEN 'luse' ELSE 'veg' END) || '/' || (53390000 + o_orderkey % 40) || '_x_op.gml' END AS name, o_custkey % 7 AS ward FROM orders"


@query(
    "s10_f11_j24_listing_plan",
    f"""WITH l AS ({_LISTING}), k AS (SELECT *, row_number() OVER (PARTITION BY name, size, crc ORDER BY ward) AS rn FROM l WHERE name LIKE 'udx/%' AND split_part(name, '/', 2) IN ('bldg', 'tran', 'veg') AND name LIKE '%\\_op.gml' ESCAPE '\\')
    SELECT ward, split_part(name, '/', 2) AS kind, count(*) AS members, sum(size)::BIGINT AS bytes FROM k WHERE rn = 1 GROUP BY 1, 2""",
)
def s10(t: Tables) -> DataFrame:
    """Listing lines parsed and filtered; a member that an earlier ward lists is left to that ward."""
    from gridspan.sources.listing import parse_listing, planned_members

    k = c("o_orderkey")
    kind = F.when(k % 4 == 0, "bldg").when(k % 4 == 1, "tran").when(k % 4 == 2, "luse").otherwise("veg")
    name = F.when(k % 5 == 0, "doc/read me.txt").otherwise(F.concat(F.lit("udx/"), kind, F.lit("/"), (53390000 + k % 40).cast("string"), F.lit("_x_op.gml")))
    line = F.concat_ws(" ", ((k % 900) * 10).cast("string"), ((k % 900) * 4).cast("string"), F.lpad((c("o_custkey") % 97).cast("string"), 8, "0"), name)
    plan = planned_members(parse_listing(t.orders.select((c("o_custkey") % 7).alias("ward"), line.alias("line"))), ["bldg", "tran", "veg"])
    return out(plan.groupBy("ward", "kind").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes")), ward="long", kind="string", members="long", bytes="long")


@query("d01_distinct_cells", "SELECT DISTINCT x, z FROM voxel", ("voxel",))
def d01(t: Tables) -> DataFrame:
    return out(t.voxel.select("x", "z").distinct(), x="long", z="long")


@query(
    "d02_first_feature_by_id",
    "WITH f AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 200 END AS gid, o_custkey % 7 AS ward FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ward, seq) AS rn FROM f) SELECT seq, coalesce(gid, -1) AS gid, ward FROM k WHERE rn = 1 OR gid IS NULL",
)
def d02(t: Tables) -> DataFrame:
    """The first feature of each id; features without an id all stay."""
    f = t.orders.select(c("o_orderkey").alias("seq"), F.when(c("o_orderkey") % 6 != 0, c("o_custkey") % 200).alias("gid"), (c("o_custkey") % 7).alias("ward"))
    d = osm.first_per_key(f, ["gid"], ["ward", "seq"], keep_nulls=True)
    return out(d.na.fill(-1, ["gid"]), seq="long", gid="long", ward="long")


@query("d03_first_seen_titles", "WITH e AS (SELECT o_custkey AS id, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) SELECT id, string_agg(p, '|' ORDER BY k) AS titles FROM e GROUP BY id")
def d03(t: Tables) -> DataFrame:
    """Distinct values in the order in which they are first seen."""
    g = t.orders.groupBy(c("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return out(g.select("id", F.concat_ws("|", F.array_distinct(F.transform("l", lambda s: s["o_orderpriority"]))).alias("titles")), id="long", titles="string")


@query("d04_normalised_names", "SELECT DISTINCT lang, trim(nfc_normalize(w)) AS name FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE trim(w) <> ''")
def d04(t: Tables) -> DataFrame:
    """Names in composed form, trimmed, empty ones dropped, each once (Spark has no normaliser)."""
    from gridspan.sources.dims import composed_names

    d = composed_names(t.documents.select("lang", F.explode(F.split("text", " ")).alias("name")), "name")
    return out(d.distinct(), lang="string", name="string")


@query(
    "w01_ranked_slugs",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 233))
    SELECT rank, lpad(rank::VARCHAR, 3, '0') || '-' || trim(both '-' FROM regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) AS id FROM r""",
)
def w01(t: Tables) -> DataFrame:
    """The first 233 by size, ranked, with ids. The rank's window holds the kept rows alone."""
    top = t.part.orderBy(c("p_retailprice").desc(), "p_partkey").limit(233)
    r = top.withColumn("rank", F.row_number().over(Window.orderBy(c("p_retailprice").desc(), "p_partkey")))
    return out(r.select("rank", F.concat(F.lpad(c("rank").cast("string"), 3, "0"), F.lit("-"), text.slug(c("p_name"))).alias("id")), rank="long", id="string")


@query("o01_longest", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o01(t: Tables) -> DataFrame:
    return out(t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(100), o_orderkey="long", o_totalprice="double")


@query("o06_first_names", "SELECT o_custkey AS id, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def o06(t: Tables) -> DataFrame:
    """At most three of each; Spark prunes groups before the shuffle."""
    d = t.orders.select(c("o_custkey").alias("id"), "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(c("o_totalprice").desc(), "o_orderkey")).alias("rn")).filter("rn <= 3")
    return out(d, id="long", o_orderkey="long", rn="long")


@query("o07_s13_every_third", "SELECT chunk, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT id, id // 4000 AS chunk, row_number() OVER (PARTITION BY id // 4000 ORDER BY id) AS rn FROM point) WHERE (rn - 1) % 3 = 0 GROUP BY chunk", ("point",))
def o07(t: Tables) -> DataFrame:
    """Every third row within each chunk, counting from its first."""
    from gridspan.operators.points import every_nth

    d = every_nth(t.point.select("id", F.floor(c("id") / 4000).alias("chunk")), ["chunk"], ["id"], 3)
    return out(d.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")), chunk="long", n="long", ids="long")


@query("u01_all_sources", "SELECT 'customer' AS kind, c_nationkey::BIGINT AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey::BIGINT, count(*) FROM supplier GROUP BY 2")
def u01(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("kind"), c("c_nationkey").alias("nation"))
    b = t.supplier.select(F.lit("supplier").alias("kind"), c("s_nationkey").alias("nation"))
    return out(a.unionByName(b).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n")), kind="string", nation="long", n="long")


@query(
    "u02_masks",
    "WITH a AS (SELECT DISTINCT x, z FROM voxel WHERE cls < 5), b AS (SELECT DISTINCT x, z FROM voxel WHERE cls > 7) SELECT 'or' AS op, x, z FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'and', x, z FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'not', x, z FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    ("voxel",),
)
def u02(t: Tables) -> DataFrame:
    """Masks of cells: or, and, and not, from one grouping instead of three set operations."""
    g = t.voxel.groupBy("x", "z").agg(F.bool_or(c("cls") < 5).alias("a"), F.bool_or(c("cls") > 7).alias("b"))
    ops = F.array(F.when(c("a") | c("b"), "or"), F.when(c("a") & c("b"), "and"), F.when(c("a") & ~c("b"), "not"))
    return out(g.select(F.explode(F.filter(ops, lambda v: v.isNotNull())).alias("op"), "x", "z"), op="string", x="long", z="long")


@query("u03_s05_unknown_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u03(t: Tables) -> DataFrame:
    """What is wanted and not known yet."""
    d = t.customer.select(c("c_custkey").alias("id")).join(t.orders.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("id")), "id", "left_anti").distinct()
    return out(d, id="long")


@query("u05_subset_check", "SELECT (SELECT count(*) FROM chunk k WHERE NOT EXISTS (SELECT 1 FROM directory d WHERE d.level = k.level AND d.cx = k.cx AND d.cz = k.cz)) AS outside, (SELECT count(*) FROM chunk) AS chunks", ("chunk", "directory"))
def u05(t: Tables) -> DataFrame:
    """Chunks that are in no slot: none, or the archive is wrong."""
    known = t.directory.select("level", "cx", "cz", F.lit(1).alias("there"))
    d = t.chunk.join(known, ["level", "cx", "cz"], "left").agg(F.count_if(c("there").isNull()).alias("outside"), F.count(F.lit(1)).alias("chunks"))
    return out(d, outside="long", chunks="long")


@query(
    "s02_alias_chains",
    "WITH RECURSIVE a AS (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part WHERE p_size > 25 AND p_partkey // 2 > 0), walk AS (SELECT p_partkey AS name, p_partkey AS cur, 0 AS d FROM part UNION ALL SELECT name, target, d + 1 FROM walk JOIN a ON cur = source WHERE d < 16) SELECT name, max_by(cur, d) AS final FROM walk GROUP BY name",
)
def s02(t: Tables) -> DataFrame:
    """Names followed through redirects to the end."""
    a = t.part.filter("p_size > 25 AND floor(p_partkey / 2) > 0").select(c("p_partkey").alias("source"), F.floor(c("p_partkey") / 2).alias("target"))
    return out(osm.resolve_aliases(t.part.select(c("p_partkey").alias("name")).distinct(), a), name="long", final="long")


@query(
    "s06_best_match_or_all_ways",
    "WITH m AS (SELECT o_custkey AS river, o_orderkey AS ref, CASE WHEN o_orderkey % 4 = 0 THEN 'relation' ELSE 'way' END AS kind, o_totalprice AS score FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY river, kind ORDER BY score DESC, ref) AS rn, count_if(kind = 'relation') OVER (PARTITION BY river) AS rels FROM m) SELECT river, kind, ref FROM r WHERE (kind = 'relation' AND rn = 1) OR (kind = 'way' AND rels = 0)",
)
def s06(t: Tables) -> DataFrame:
    """The first relation of a lookup, or all its ways where there is none."""
    k = c("o_orderkey")
    m = t.orders.select(c("o_custkey").alias("river"), k.alias("ref"), F.when(k % 4 == 0, "relation").otherwise("way").alias("kind"), c("o_totalprice").alias("score"))
    r = m.withColumn("rn", F.row_number().over(Window.partitionBy("river", "kind").orderBy(c("score").desc(), "ref"))).withColumn("rels", F.count_if(c("kind") == "relation").over(Window.partitionBy("river")))
    return out(r.filter("(kind = 'relation' AND rn = 1) OR (kind = 'way' AND rels = 0)"), river="long", kind="string", ref="long")


@query(
    "f01_f02_tag_layers",
    """WITH e AS (SELECT o_orderkey AS id, o_orderkey % 12 AS k, o_custkey % 2 = 0 AS closed FROM orders)
    SELECT layer, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT id, unnest(CASE k WHEN 0 THEN CASE WHEN closed THEN ['building'] ELSE [] END WHEN 1 THEN [] WHEN 2 THEN ['road', 'lit', 'sidewalk_left', 'sidewalk_right'] WHEN 3 THEN ['foot'] WHEN 4 THEN [] WHEN 5 THEN ['rail', 'bridge']
    WHEN 6 THEN CASE WHEN closed THEN ['veg', 'noTree'] ELSE [] END WHEN 7 THEN CASE WHEN closed THEN ['sparse'] ELSE [] END WHEN 8 THEN ['water'] WHEN 9 THEN ['road', 'bridge'] WHEN 10 THEN CASE WHEN closed THEN ['water'] ELSE [] END ELSE ['treerow'] END) AS layer FROM e WHERE k <> 11 OR NOT closed) GROUP BY layer""",
)
def f01(t: Tables) -> DataFrame:
    """Elements of twelve kinds, open and closed, to the layers that they feed."""
    kinds = [
        {"building": "yes"}, {"building": "yes", "layer": "-2"}, {"highway": "primary", "lit": "yes", "sidewalk": "both"}, {"highway": "footway"}, {"highway": "primary", "tunnel": "yes"}, {"railway": "rail", "bridge": "yes"},
        {"leisure": "park", "amenity": "parking"}, {"landuse": "cemetery", "natural": "wood"}, {"waterway": "stream"}, {"highway": "service", "bridge": "viaduct"}, {"natural": "water"}, {"natural": "tree_row"},
    ]
    k = c("o_orderkey") % 12
    tags = None
    for i, kv in enumerate(kinds):
        m = F.create_map(*[F.lit(x) for p in kv.items() for x in p])
        tags = F.when(k == i, m) if tags is None else tags.when(k == i, m)
    nds = F.when(c("o_custkey") % 2 == 0, F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    d = t.orders.select(c("o_orderkey").alias("id"), tags.alias("tags"), nds.alias("nds"))
    d = d.select("id", F.explode(osm.layers(c("tags"), osm.is_area(c("nds"), c("tags")))).alias("layer"))
    return out(d.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")), layer="string", n="long", ids="long")


@query("f05_centre_line_members", "SELECT o_custkey AS relation, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F', 'O') GROUP BY 1")
def f05(t: Tables) -> DataFrame:
    """Allowed kinds without skipped roles."""
    d = t.orders.filter(~c("o_orderpriority").isin("1-URGENT", "5-LOW") & c("o_orderstatus").isin("F", "O"))
    return out(d.groupBy(c("o_custkey").alias("relation")).agg(F.count(F.lit(1)).alias("n")), relation="long", n="long")


@query("f07_best_lod", "SELECT gid, lod, n FROM (SELECT o_custkey AS gid, 'lod' || (o_orderkey % 4) || '_' || o_orderstatus AS lod, count(*) AS n, rank() OVER (PARTITION BY o_custkey ORDER BY max(o_orderkey % 4) DESC, 'lod' || (o_orderkey % 4) || '_' || o_orderstatus DESC) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def f07(t: Tables) -> DataFrame:
    """The finest geometry of each feature, by level and then by name."""
    g = t.orders.groupBy(c("o_custkey").alias("gid"), (c("o_orderkey") % 4).alias("level"), F.concat(F.lit("lod"), (c("o_orderkey") % 4).cast("string"), F.lit("_"), c("o_orderstatus")).alias("lod")).agg(F.count(F.lit(1)).alias("n"))
    d = g.groupBy("gid").agg(F.max_by(F.struct("lod", "n"), F.struct("level", "lod")).alias("b"))
    return out(d.select("gid", "b.lod", "b.n"), gid="long", lod="string", n="long")


@query(
    "f06_function_codes",
    "SELECT code, kind, count(*) AS n FROM (SELECT (p_size % 10) * 1000 + (p_partkey % 3) * 10 AS code, CASE WHEN (p_size % 10) * 1000 + (p_partkey % 3) * 10 IN (2000, 2010, 2020, 3000, 3010, 3020) THEN 'sidewalk' WHEN (p_size % 10) * 1000 + (p_partkey % 3) * 10 IN (5000, 5010, 5020) THEN 'veg' ELSE 'road' END AS kind FROM part) GROUP BY 1, 2",
)
def f06(t: Tables) -> DataFrame:
    """Function codes of traffic areas to classes; unknown codes are road."""
    from gridspan.sources.citygml import surface_kind

    code = (c("p_size") % 10) * 1000 + (c("p_partkey") % 3) * 10
    d = t.part.select(code.alias("code"), surface_kind(code.cast("string")).alias("kind"))
    return out(d.groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n")), code="long", kind="string", n="long")


@query("s21_s22_tag_counts", "SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS high, count(CASE WHEN (props->>'k')::INT % 2 = 0 THEN 1 END) AS even FROM events GROUP BY 1")
def s21(t: Tables) -> DataFrame:
    d = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") > 50).alias("high"), F.count_if(F.from_json("props", "k int")["k"] % 2 == 0).alias("even"))
    return out(d, event_type="string", n="long", high="long", even="long")
