"""OSM extracts, XML or binary: highway ways with their vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import pbf

TAG = "array<struct<_k: string, _v: string>>"


def _xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id long, _lat double, _lon double").load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd array<struct<_ref: long>>, tag {TAG}").load(path)
    attrs = F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])))
    return nodes.select(F.col("_id").alias("ref"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat")), ways.select(F.col("_id").alias("osm_way_id"), F.transform("nd", lambda x: x["_ref"]).alias("refs"), attrs.alias("attrs"))


def _pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes, ways = pbf.read(spark, path, "node"), pbf.read(spark, path, "way")
    return nodes.select(F.col("id").alias("ref"), "lon", "lat"), ways.select(F.col("id").alias("osm_way_id"), "refs", F.col("tags").alias("attrs"))


def read_ways(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """osm_way_id, coords, attrs: ways tagged highway with at least two known vertices; with a box, those with a vertex in it. XML, or .pbf."""
    nodes, ways = (_pbf if path.endswith(".pbf") else _xml)(spark, path)
    ways = ways.where(F.map_contains_key("attrs", F.lit("highway")))
    placed = ways.select("osm_way_id", F.posexplode("refs").alias("pos", "ref")).join(nodes, "ref")
    lines = placed.groupBy("osm_way_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("lon", "lat").alias("p")))).alias("v"))
    out = ways.join(lines, "osm_way_id").where((F.size("v") == F.size("refs")) & (F.size("v") >= 2)).select("osm_way_id", F.transform("v", lambda x: x["p"]).alias("coords"), "attrs")
    return out if box is None else out.where(geo.bbox_hit(F.col("coords"), *box))


def extract_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
