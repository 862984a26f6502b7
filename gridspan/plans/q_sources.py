"""Queries of sources and sinks on made-up inputs (files are covered by tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspan.plans.registry import Tables, out, query
from gridspan.sources import blocks, elevation, html_tables

c = F.col


@query("s01_ranked_html_rows", "SELECT (p_partkey % 20) AS page, p_partkey AS item, p_name || ' river' AS name, (p_size * 100 + 1234)::BIGINT AS length_km, 'A_' || p_partkey || '|B' AS titles FROM part")
def s01(t: Tables) -> DataFrame:
    """The second table of a class in a page: names, lengths, links."""
    k = c("p_partkey").cast("string")
    cell = F.concat(F.lit('<td><a href="/wiki/A_'), k, F.lit('#x">'), c("p_name"), F.lit('</a> river [note 1] <a href="/wiki/File:z.svg"></a><a href="/wiki/B">'), F.lit('</a><a href="/wiki/B#t"></a></td>'))
    row = F.concat(F.lit("<tr><th>"), k, F.lit("</th>"), cell, F.lit("<td>"), F.format_number(c("p_size") * 100 + 1234, 0), F.lit(" (est.)</td></tr>"))
    head = '<table class="x"><tr><td>no</td></tr></table><table class="sortable wikitable"><tr><th>a</th></tr></table><p>between</p><table class="wikitable"><tr><th>Rank</th><th>River</th><th>Length</th></tr>'
    pages = t.part.groupBy((c("p_partkey") % 20).alias("page")).agg(F.concat(F.lit(head), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda s: s["r"])), F.lit("</table>")).alias("html"))
    d = html_tables.ranked_rows(html_tables.table_cells(pages, "page", "html", "wikitable", 1), "page")
    return out(d.select("page", F.substring(c("titles")[0], 3, 12).alias("item"), "name", "length_km", F.concat_ws("|", "titles").alias("titles")), page="long", item="long", name="string", length_km="long", titles="string")


@query("s01_page_links", "SELECT page_id, pos - 1 AS pos, regexp_extract(l, 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"[^\"]*\"') AS ls FROM pages))")
def s01_links(t: Tables) -> DataFrame:
    """Links of pages in order."""
    return out(html_tables.links(t.pages, "page_id", "html"), page_id="long", pos="long", href="string")


@query("s11_elevation_pixels", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(CASE WHEN v < 8388608 THEN v * 0.01 WHEN v > 8388608 THEN (v - 16777216) * 0.01 END, 4) AS h FROM (SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey % 256) * 65536 + (l_partkey % 256) * 256 + l_suppkey % 256 AS v FROM lineitem)")
def s11(t: Tables) -> DataFrame:
    h = elevation.decoded_height(c("l_orderkey") % 256, c("l_partkey") % 256, c("l_suppkey") % 256)
    return out(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", h.alias("h")), l_orderkey="long", l_linenumber="long", l_partkey="long", h="round4")


@query(
    "s15_f17_block_sections",
    """WITH s AS (SELECT s_suppkey AS cx, i FROM supplier, (SELECT unnest(range(0, 4096)) AS i)), b AS (SELECT cx, i, (cx * 7 + (i % 16) + (i // 16) % 5) % 6 AS k FROM s), n AS (SELECT cx, i // 256 AS y, (['air', 'gray_concrete', 'oak_log', 'oak_fence', 'stone_brick_wall', 'stone'])[k + 1] AS name FROM b)
    SELECT cx, y, name, CASE name WHEN 'air' THEN 'air' WHEN 'oak_log' THEN 'veg' WHEN 'oak_fence' THEN 'fence' WHEN 'stone_brick_wall' THEN 'lamp' ELSE 'solid' END AS kind, count(*) AS n FROM n GROUP BY 1, 2, 3""",
)
def s15(t: Tables) -> DataFrame:
    """Packed block indices to names and kinds."""
    pal = F.array(*[F.lit("minecraft:" + n) for n in ("air", "gray_concrete", "oak_log", "oak_fence", "stone_brick_wall", "stone")])
    k = c("s_suppkey")
    word = lambda w: F.aggregate(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda a, j: a * 16 + (k * 7 + j + w % 5) % 6)
    data = F.transform(F.sequence(F.lit(0), F.lit(255)), word)
    d = t.supplier.select(k.alias("cx"), F.lit(0).alias("cz"), F.lit(0).alias("sy"), pal.alias("palette"), data.alias("data"))
    b = blocks.section_blocks(d).withColumn("kind", blocks.block_kind(c("name")))
    return out(b.groupBy("cx", "y", "name", "kind").agg(F.count(F.lit(1)).alias("n")), cx="long", y="long", name="string", kind="string", n="long")


@query("s16_grid_bytes", "SELECT p_partkey AS id, i::BIGINT AS i, ('0x' || substr(m, 2 * i::INT + 1, 2))::BIGINT AS value FROM (SELECT p_partkey, md5(p_name) AS m FROM part), (SELECT unnest(range(0, 16)) AS i)")
def s16(t: Tables) -> DataFrame:
    """A binary grid as a row for each byte."""
    from gridspan.sources.voxel_files import byte_cells

    d = t.part.select(c("p_partkey").alias("id"), F.unhex(F.md5("p_name")).alias("data"))
    return out(byte_cells(d, "id", "data"), id="long", i="long", value="long")


@query("k07_slim_records", "SELECT p_partkey AS id, p_name AS common, 'r' || (p_size % 7) AS \"riverId\" FROM part")
def k07(t: Tables) -> DataFrame:
    """Full records to the few fields that are served."""
    d = t.part.select(c("p_partkey").alias("id"), c("p_name").alias("common"), F.concat(F.lit("r"), (c("p_size") % 7).cast("string")).alias("riverId"))
    return out(d, id="long", common="string", riverId="string")


@query("k01_voxel_counts", "SELECT 'c' || k.cls AS name, count(v.cls) AS n FROM (SELECT unnest(range(0, 13)) AS cls) k LEFT JOIN voxel v USING (cls) GROUP BY 1", ("voxel",))
def k01(t: Tables) -> DataFrame:
    """The class counts that go with a voxel file."""
    from gridspan.operators.grid import class_histogram

    return out(class_histogram(t.voxel, []).select(F.concat(F.lit("c"), c("cls").cast("string")).alias("name"), "n"), name="string", n="long")


@query("s12_cropped_cloud", "SELECT l_orderkey, l_partkey::DOUBLE AS x, (l_suppkey * 3)::DOUBLE AS y, ((l_orderkey * 7919 % 65536) // 256)::BIGINT AS r, ((l_partkey * 104729 % 65536) // 256)::BIGINT AS g FROM lineitem WHERE l_partkey >= 96 AND l_partkey < 264 AND l_suppkey * 3 >= 16 AND l_suppkey * 3 < 184")
def s12(t: Tables) -> DataFrame:
    """Points of a box with its margin, colours brought to eight bits."""
    from gridspan.operators.points import cropped

    k, p, s = c("l_orderkey"), c("l_partkey"), c("l_suppkey")
    d = t.lineitem.select(k, p.cast("double").alias("x"), (s * 3).cast("double").alias("y"), (k * 7919 % 65536).alias("r"), (p * 104729 % 65536).alias("g"), F.lit(0).alias("b"))
    return out(cropped(d, 100, 20, 160), l_orderkey="long", x="double", y="double", r="long", g="long")


@query("s20_byte_slices", "SELECT o_orderkey, substr(n_name || '/' || n_name, 1 + (o_orderkey % 5)::INT, 1 + (o_custkey % 4)::INT) AS piece FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def s20(t: Tables) -> DataFrame:
    """Ranges cut out of whole binary files."""
    from gridspan.operators.codec import slices_of

    shards = t.nation.select(c("n_nationkey").cast("long").alias("shard"), F.concat("n_name", F.lit("/"), "n_name").cast("binary").alias("content"))
    refs = t.orders.select("o_orderkey", (c("o_custkey") % 25).alias("shard"), (c("o_orderkey") % 5).cast("int").alias("start"), (1 + c("o_custkey") % 4).cast("int").alias("len"))
    return out(slices_of(shards, refs).select("o_orderkey", c("blob").cast("string").alias("piece")), o_orderkey="long", piece="string")


@query("f23_checked_rows", "SELECT count(*) AS n, count(CASE WHEN p_size BETWEEN 1 AND 200 THEN 1 END) AS good FROM part")
def f23(t: Tables) -> DataFrame:
    """A boundary check that fails the query on a row outside the rules."""
    from gridspan.sources.dims import checked

    d = checked(t.part, {"size within 1..200": c("p_size").between(1, 200), "a name": F.length("p_name") > 0})
    return out(d.agg(F.count(F.lit(1)).alias("n"), F.count_if(c("p_size").between(1, 200)).alias("good")), n="long", good="long")
