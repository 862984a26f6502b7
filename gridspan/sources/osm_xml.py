"""Map extracts in XML (Spark's own reader) and in JSON: nodes, ways and relations as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag array<struct<_k string, _v string>>"


def _tags() -> F.Column:
    return F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v"))), F.array().cast("array<struct<k string, v string>>")))


def read_osm_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (id, lon, lat, tags), ways (id, nds, tags), relations (id, members, tags). The schema is
    declared; each table is one pass with its own row tag."""

    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema).load(path)

    nodes = rows("node", f"_id long, _lon double, _lat double, {_TAGS}").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags().alias("tags"))
    ways = rows("way", f"_id long, nd array<struct<_ref long>>, {_TAGS}").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nds"), _tags().alias("tags"))
    members = F.transform("member", lambda m: F.struct(m["_type"].alias("kind"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role")))
    relations = rows("relation", f"_id long, member array<struct<_type string, _ref long, _role string>>, {_TAGS}").select(F.col("_id").alias("id"), members.alias("members"), _tags().alias("tags"))
    return {"nodes": nodes, "ways": ways, "relations": relations}


ELEMENT = "struct<type string, id long, lat double, lon double, nodes array<long>, tags map<string, string>, members array<struct<type string, ref long, role string>>>"


def read_osm_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same tables from files {"elements": [...]}."""
    raw = spark.read.text(path, wholetext=True)
    e = raw.select(F.explode(F.from_json("value", f"struct<elements array<{ELEMENT}>>", {"mode": "FAILFAST"})["elements"]).alias("e")).select("e.*")
    empty = F.create_map().cast("map<string,string>")
    tags = F.coalesce("tags", empty).alias("tags")
    return {
        "nodes": e.filter("type = 'node'").select("id", "lon", "lat", tags),
        "ways": e.filter("type = 'way'").select("id", F.col("nodes").alias("nds"), tags),
        "relations": e.filter("type = 'relation'").select("id", F.transform("members", lambda m: F.struct(m["type"].alias("kind"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role"))).alias("members"), tags),
    }


def relation_members(relations: DataFrame) -> DataFrame:
    """(relation, pos, kind, ref, role)."""
    return relations.select(F.col("id").alias("relation"), F.posexplode("members").alias("pos", "m")).select("relation", "pos", "m.kind", "m.ref", "m.role")
