"""Readers and sinks on tiny files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.operators import osm
from gridspan.sources import blocks, citygml, dims, html_tables, listing, osm_xml, voxel_files

OSM = """<?xml version="1.0"?><osm>
<node id="1" lat="35.0" lon="139.0"><tag k="natural" v="tree"/></node><node id="2" lat="35.1" lon="139.1"/><node id="3" lat="35.2" lon="139.2"/>
<way id="10"><nd ref="1"/><nd ref="9"/><nd ref="3"/><tag k="highway" v="primary"/></way>
<relation id="20"><member type="way" ref="10" role="outer"/><member type="relation" ref="21" role=""/><tag k="type" v="multipolygon"/></relation></osm>"""

GML = """<?xml version="1.0"?><core:CityModel xmlns:core="c" xmlns:gml="http://g" xmlns:tran="t" xmlns:bldg="b">
<tran:Road gml:id="r1"><tran:function>1000</tran:function><tran:lod1MultiSurface><gml:Polygon><gml:exterior><gml:posList>35 139 1 35 140 1 36 140 2 35 139 1</gml:posList></gml:exterior></gml:Polygon></tran:lod1MultiSurface>
<tran:trafficArea><tran:TrafficArea gml:id="a1"><tran:function>2000</tran:function><tran:lod2MultiSurface><gml:Polygon><gml:exterior><gml:posList>0 0 0 0 1 0 1 1 0 0 0 0</gml:posList></gml:exterior><gml:interior><gml:posList>0 0 5 0 1 5 1 1 5 0 0 5</gml:posList></gml:interior></gml:Polygon></tran:lod2MultiSurface></tran:TrafficArea></tran:trafficArea></tran:Road>
<tran:Road gml:id="r2"><tran:lod1MultiSurface><gml:Polygon><gml:exterior><gml:posList>1 1 1 1 2 1 2 2 1 1 1 1</gml:posList></gml:exterior></gml:Polygon></tran:lod1MultiSurface></tran:Road>
<bldg:Building><bldg:lod1Solid><gml:Polygon><gml:exterior><gml:posList>1 1 9 1 2 9 2 2 9 1 1 9</gml:posList></gml:exterior></gml:Polygon></bldg:lod1Solid></bldg:Building></core:CityModel>"""


def test_osm_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    t = osm_xml.read_osm_xml(spark, str(tmp_path / "a.osm"))
    assert t["nodes"].filter("id = 1").first().tags == {"natural": "tree"}
    assert t["ways"].first().nds == [1, 9, 3]
    line = osm.way_lines(t["ways"], t["nodes"]).first().line
    assert [p.lon for p in line] == [139.0, 139.2]  # the unknown node is left out
    m = osm_xml.relation_members(t["relations"]).orderBy("pos").collect()
    assert [(r.kind, r.ref, r.role) for r in m] == [("way", 10, "outer"), ("relation", 21, "")]


def test_osm_json(spark, tmp_path):
    e = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 5, "nodes": [1], "tags": {"waterway": "river"}}, {"type": "relation", "id": 7, "members": [{"type": "way", "ref": 5}]}]
    (tmp_path / "a.json").write_text(json.dumps({"elements": e}))
    t = osm_xml.read_osm_json(spark, str(tmp_path / "a.json"))
    assert t["nodes"].first().tags == {} and t["ways"].first().tags == {"waterway": "river"}
    assert t["relations"].first().members[0].role == ""


def test_citygml(spark, tmp_path):
    (tmp_path / "a.gml").write_text(GML)
    f = citygml.read_features(spark, str(tmp_path / "a.gml"), ["Road", "Building"]).orderBy("seq").collect()
    assert [(r.kind, r.gid, r.function) for r in f] == [("TrafficArea", "a1", "2000"), ("Road", "r2", None), ("Building", None, None)]
    assert len(f[0].lods["lod2MultiSurface"][0].holes) == 1
    assert list(f[2].lods) == ["lod1"]
    d = citygml.read_features(spark, str(tmp_path / "a.gml"), ["Building"])
    assert citygml.triangles(d).first().shell[2].h == 9
    assert citygml.unique_features(d.unionByName(d), ["file", "seq"]).count() == 2  # no id: both stay


def test_json_dims(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"a": [{"lang": "ja", "name": " が "}, {"lang": "xx", "name": "が"}, {"lang": "en", "name": " "}]}))
    got = dims.read_names(spark, str(tmp_path / "n.json")).collect()
    assert [(r.id, r.pos, r.lang, r.name) for r in got] == [("a", 0, "ja", "が")]
    (tmp_path / "bad.json").write_text("[1, 2")
    with pytest.raises(Exception):
        dims.read_rows(spark, str(tmp_path / "bad.json"), dims.PLACES).collect()


def test_listing(spark, tmp_path):
    (tmp_path / "13101.txt").write_text("10 4 00aa udx/bldg/1_bldg_op.gml\nbad line\n5 2 00bb read me first.txt\n")
    got = listing.parse_listing(listing.read_listing(spark, str(tmp_path / "13101.txt"))).orderBy("size").collect()
    assert [(r.ward, r.size, r.name) for r in got] == [("13101", 5, "read me first.txt"), ("13101", 10, "udx/bldg/1_bldg_op.gml")]


def test_html_without_tables(spark):
    p = spark.createDataFrame([(1, None), (2, "<p>x"), (3, "<table class=wikitable><tr><td>1")], "id long, html string")
    assert html_tables.ranked_rows(html_tables.table_cells(p, "id", "html", "wikitable", 0), "id").collect() == []


def test_block_sections(spark):
    rng = np.random.default_rng(0)
    names = [f"minecraft:b{i}" for i in range(20)]
    idx = rng.integers(0, 20, 4096)
    longs = []
    for k in range(0, 4096, 12):  # five bits: twelve to a long, none straddles
        v = sum(int(i) << (5 * j) for j, i in enumerate(idx[k : k + 12]))
        longs.append(v - (1 << 64) if v >= 1 << 63 else v)
    d = spark.createDataFrame([(0, 0, 0, names, longs), (1, 0, 0, ["minecraft:air"], None)], "cx int, cz int, sy int, palette array<string>, data array<long>")
    got = {(r.cx, r.y, r.z, r.x): r.name for r in blocks.section_blocks(d).collect()}
    assert all(got[0, i >> 8, i >> 4 & 15, i & 15] == f"b{v}" for i, v in enumerate(idx))
    assert got[1, 3, 2, 1] == "air"


def test_voxel_files(spark, tmp_path):
    cells = np.arange(24, dtype=np.uint8) % 13
    (tmp_path / "a.bin").write_bytes(cells.tobytes())
    got = {(r.x, r.y, r.z): r.cls for r in voxel_files.read_voxels(spark, str(tmp_path / "a.bin"), 2, 3, 4).collect()}
    assert got == {(i % 2, i // 8, i // 2 % 4): int(v) for i, v in enumerate(cells) if v}
    with pytest.raises(Exception):
        voxel_files.read_voxels(spark, str(tmp_path / "a.bin"), 2, 2, 4).collect()
    v = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 4), (1, 0, 0, 1)], "x long, y long, z long, cls long")
    voxel_files.write_voxels(v, str(tmp_path / "out"), {"id": "t"})
    meta = json.loads(next((tmp_path / "out/meta").glob("part-*")).read_text())
    assert meta["classCounts"]["ground"] == 2 and meta["classCounts"]["pole"] == 0


def test_layer_windows(spark, tmp_path):
    d = spark.range(0, 1100, 50).select(F.col("id").cast("int").alias("x"), F.lit(3).alias("z"), F.lit(1.5).cast("float").alias("h"), *[F.lit(None).cast(t).alias(n) for n, t in (("w", "float"), ("rc", "smallint"), ("rc_lod", "smallint"), ("bh", "float"), ("deck", "float"))], F.lit(True).alias("cover"))
    voxel_files.write_layers(d, str(tmp_path / "l"))
    w = voxel_files.read_layer_window(spark, str(tmp_path / "l"), 500, 700, 0, 10)
    assert sorted(r.x for r in w.collect()) == [500, 550, 600, 650]
    assert "PartitionFilters: [isnotnull(sx" in w._jdf.queryExecution().toString().replace("\n", " ")
