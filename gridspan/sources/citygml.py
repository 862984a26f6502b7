"""City models: features with polygons by level of detail, from XML files.

Files are read whole, one a row, and parsed with the standard library's incremental parser in Arrow
batches; a feature is emitted and cleared before the next, so memory is bounded by one file's text.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Function codes of traffic areas and of city furniture.
SIDEWALK_CODES = ["2000", "2010", "2020", "2030", "3000", "3010", "3020"]
PLANT_CODES = ["5000", "5010", "5020"]
POLE_CODES = ["4200", "4800", "4810", "4820", "4830", "4840", "4900", "4600", "4300", "4235", "4236"]
FENCE_CODE = "2000"
FLAT_CODES = [
    "1000", "1010", "1020", "1030", "1040", "1100", "1110", "1120", "1200", "5000", "5010", "5020", "5030", "5100", "5200", "5300", "5400", "5500", "5600", "5610", "5620", "5630",
    "7000", "7100", "7200", "7300", "7400", "7500", "8070", "8150", "6000", "6010", "6020",
]

RING = "array<struct<lat double, lon double, h double>>"
SCHEMA = f"kind string, gid string, function string, lods map<string, array<struct<shell: {RING}, holes: array<{RING}>>>>"
_LOD = re.compile(r"lod\d.*(?:MultiSurface|Solid|Geometry)$")


def surface_kind(code: Column) -> Column:
    """road, sidewalk or veg; what is not known is road."""
    return F.when(code.isin(SIDEWALK_CODES), "sidewalk").when(code.isin(PLANT_CODES), "veg").otherwise("road")


def furniture_kind(code: Column) -> Column:
    """pole, fence, furniture, or null for flat things that are left out."""
    return F.when(code.isin(FLAT_CODES), F.lit(None)).when(code.isin(POLE_CODES), "pole").when(code == FENCE_CODE, "fence").otherwise("furniture")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _ring(text: str | None) -> list[dict]:
    v = [float(x) for x in (text or "").split()]
    return [{"lat": v[i], "lon": v[i + 1], "h": v[i + 2]} for i in range(0, len(v) - 2, 3)]


def _polygons(el: ET.Element) -> list[dict]:
    out = []
    for poly in (e for e in el.iter() if _name(e.tag) == "Polygon"):
        rings = {"exterior": [], "interior": []}
        for side in poly:
            if _name(side.tag) in rings:
                rings[_name(side.tag)] += [_ring(p.text) for p in side.iter() if _name(p.tag) == "posList"]
        if rings["exterior"]:
            out.append({"shell": rings["exterior"][0], "holes": rings["interior"]})
    return out


def _lods(el: ET.Element, deep: bool) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for g in el.iter() if deep else el:
        if _LOD.match(_name(g.tag)) and (polys := _polygons(g)):
            out.setdefault(_name(g.tag)[:4] if deep else _name(g.tag), []).extend(polys)
    return out


def _feature(el: ET.Element, lods: dict) -> dict:
    gid = next((v for k, v in el.attrib.items() if _name(k) == "id"), None)
    code = next(((e.text or "").strip() for e in el if _name(e.tag) in ("function", "usage")), None)
    return {"kind": _name(el.tag), "gid": gid, "function": code, "lods": list(lods.items())}


def features(data: bytes, kinds: set[str]) -> list[dict]:
    """Features of these kinds in file order. A road gives its traffic areas where they have geometry,
    else its own polygons; other features gather every geometry below them by level."""
    out = []
    for _, el in ET.iterparse(io.BytesIO(data)):
        name = _name(el.tag)
        if name not in kinds:
            continue
        if name == "Road":
            areas = [_feature(a, g) for a in el.iter() if _name(a.tag) in ("TrafficArea", "AuxiliaryTrafficArea") and (g := _lods(a, False))]
            own = _lods(el, False)
            out += areas or ([_feature(el, own)] if own else [])
        elif lods := _lods(el, True):
            out.append(_feature(el, lods))
        el.clear()
    return out


def read_features(spark: SparkSession, path: str, kinds: list[str]) -> DataFrame:
    """(file, seq, kind, gid, function, lods) of the XML files at ``path``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    wanted = set(kinds)

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = features(data, wanted)
                schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("kind", pa.string()), ("gid", pa.string()), ("function", pa.string()), ("lods", _ARROW)])
                yield pa.RecordBatch.from_pylist([{"file": file, "seq": i, **r} for i, r in enumerate(rows)], schema)

    return files.mapInArrow(run, f"file string, seq long, {SCHEMA}")


_POINTS = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64()), ("h", pa.float64())]))
_ARROW = pa.map_(pa.string(), pa.list_(pa.struct([("shell", _POINTS), ("holes", pa.list_(_POINTS))])))


def triangles(found: DataFrame) -> DataFrame:
    """(file, seq, lod, tri, shell of 3 points): the first three points of every polygon of a TIN."""
    d = found.select("file", "seq", F.explode("lods").alias("lod", "polys")).select("file", "seq", "lod", F.posexplode("polys").alias("tri", "p"))
    return d.select("file", "seq", "lod", "tri", F.slice("p.shell", 1, 3).alias("shell")).filter(F.size("shell") == 3)


def unique_features(found: DataFrame, order: list[str]) -> DataFrame:
    """The first feature of each id over all files; features without an id all stay."""
    from gridspan.operators.osm import first_per_key

    return first_per_key(found, ["gid"], order, keep_nulls=True)
