"""Street imagery metadata pages, one for each waypoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "data array<struct<id: string, captured_at: bigint, compass_angle: double, camera_parameters: array<double>, thumb_1024_url: string>>"
HALF_BOX = 0.0001


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*")


def marshal(images: DataFrame, provider: str, start, end) -> DataFrame:
    """Images captured within the closed date window, headings in [0, 360); images without a date go."""
    day = F.to_date(F.timestamp_millis("captured_at"))
    own = [c for c in ("segment_id", "sample_index") if c in images.columns]
    heading = F.pmod(F.coalesce("compass_angle", F.lit(0.0)), F.lit(360.0))
    out = images.select(*own, F.lit(provider).alias("provider"), F.col("id").alias("provider_image_id"), day.alias("capture_date"), heading.alias("heading_deg"), "camera_parameters", "thumb_1024_url")
    return out.where(F.col("capture_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def waypoint_boxes(points: DataFrame) -> DataFrame:
    """points (lon, lat) with the box that is asked for around each."""
    lon, lat = F.col("lon"), F.col("lat")
    return points.select("*", (lon - HALF_BOX).alias("min_lon"), (lat - HALF_BOX).alias("min_lat"), (lon + HALF_BOX).alias("max_lon"), (lat + HALF_BOX).alias("max_lat"))


def nearest_waypoint(found: DataFrame, points: DataFrame) -> DataFrame:
    """found (id, segment_id, sample_index, lon, lat, ...) with one row for each image and segment: that of the nearest of its waypoints.

    points: segment_id, sample_index, at_lon, at_lat. Images without a place count for their segment's first waypoint.
    """
    d2 = F.pow(F.col("lon") - F.col("at_lon"), 2) + F.pow(F.col("lat") - F.col("at_lat"), 2)
    j = found.join(points.select("segment_id", "sample_index", "at_lon", "at_lat"), ["segment_id", "sample_index"])
    rest = [c for c in found.columns if c not in ("id", "segment_id")]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce(d2, F.lit(float("inf"))), "sample_index"))
    return j.groupBy("id", "segment_id").agg(best.alias("b")).select("id", "segment_id", "b.*").select(*found.columns)


def attach(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Landed images (id, lon, lat, ...) with segment_id and sample_index of the waypoints in whose boxes they lie, the nearest for each segment.

    boxes: waypoint_boxes(). An equi-join on cells as wide as a box: waypoints are exploded to nine cells, images stay as they are.
    """
    cell = lambda v: F.floor(v / (2 * HALF_BOX)).cast("long")
    points = boxes.select("segment_id", "sample_index", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("at_lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("at_lat"), "min_lon", "min_lat", "max_lon", "max_lat")
    x, y = cell(F.col("at_lon")), cell(F.col("at_lat"))
    around = F.array(*(F.struct((x + i).alias("cx"), (y + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = points.withColumn("c", F.explode(around)).select("*", "c.cx", "c.cy").drop("c")
    met = images.where("lon IS NOT NULL AND lat IS NOT NULL").withColumns({"cx": cell(F.col("lon")), "cy": cell(F.col("lat"))}).join(near, ["cx", "cy"])
    met = met.where(F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat")))
    return nearest_waypoint(met.select("segment_id", "sample_index", *images.columns), points)
