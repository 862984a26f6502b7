"""Small validated dimensions in JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACES = "array<struct<id string, name string, kind string, address string, lat double, lon double, epsg6677 array<int>, sprite string>>"
NAMES = "map<string, array<struct<lang string, name string>>>"
AREA = "id string, name string, center struct<lat double, lon double>, epsg int, sw struct<x int, y int>, sizeM int, metersPerCube int, dims array<int>, bboxWGS84 struct<west double, south double, east double, north double>"


def read_json_value(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One value a file, of a declared schema; a file that does not parse is an error."""
    raw = spark.read.text(path, wholetext=True)
    d = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("value"))
    return d.select(F.when(F.col("value").isNull(), F.raise_error(F.lit(f"{path} does not hold {schema[:40]}"))).otherwise(F.col("value")).alias("value"))


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a JSON array of objects."""
    return read_json_value(spark, path, schema).select(F.explode("value").alias("r")).select("r.*")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos, lang, name): names by id, composed, trimmed, empty ones dropped, each once."""
    rows = read_json_value(spark, path, NAMES).select(F.explode("value").alias("id", "list")).select("id", F.posexplode("list").alias("pos", "n")).select("id", "pos", "n.lang", "n.name")
    d = composed_names(rows, "name")
    return d.groupBy("id", "name").agg(F.min_by(F.struct("pos", "lang"), "pos").alias("f")).select("id", "f.pos", "f.lang", "name")


def checked(df: DataFrame, rules: dict[str, F.Column]) -> DataFrame:
    """``df``, whose every row must meet all rules (a null counts as not met); the first row that does not
    fails the query with the rule's name. The check rides on the scan: no extra pass."""
    bad = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        bad = F.when(F.coalesce(rule, F.lit(False)), bad).otherwise(F.lit(name))
    return df.filter(F.when(bad.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("a row breaks the rule: "), bad)).cast("boolean")))


def composed_names(df: DataFrame, column: str) -> DataFrame:
    """``column`` in normal form C and trimmed; rows whose name is then empty or null are dropped."""

    @F.pandas_udf(T.StringType())
    def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.str.normalize("NFC").str.strip()

    return df.withColumn(column, compose(F.col(column))).filter((F.col(column) != "") & F.col(column).isNotNull())
