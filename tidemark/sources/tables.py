"""Readers of the input tables, and of the text formats that records come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """One row per point feature of GeoJSON files: properties, lon, lat."""
    raw = spark.read.option("multiLine", True).schema("features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: array<double>>>>").json(path)
    f = raw.select(F.explode("features").alias("f")).where("f.geometry.type = 'Point'")
    return f.select("f.properties", F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"))


def csv_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").schema(schema).csv(path)


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def dms(raw: Column) -> Column:
    """Degrees from decimal text or from degrees, minutes, seconds with a hemisphere."""
    part = lambda k: F.regexp_extract(raw, r"(\d+)\D+(\d+)\D+([\d.]+)\D*([NSEWnsew])", k).try_cast("double")
    sign = F.when(F.upper(raw).rlike("[SW]"), -1.0).otherwise(1.0)
    return F.coalesce(F.trim(raw).try_cast("double"), sign * (part(1) + part(2) / 60 + part(3) / 3600))
