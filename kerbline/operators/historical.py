"""Incidents near segments: a distance join on cells that follow the latitude, and the kernel sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, risk
from ..shared import join_dealt


def grid(radius_m: float):
    """Functions of columns: the row of a latitude, how many columns a row has, and the column of a longitude in a row.

    Rows are as high as the radius. A row's columns are as wide as the radius is in degrees at the latitude, within it or a row
    beside it, that is nearest a pole; a row that reaches a pole is one column. Columns wrap at the antimeridian.
    """
    dy = math.degrees(radius_m / geo.EARTH_M) * (1 + 1e-9)

    def row(lat: Column) -> Column:
        return F.floor(lat / dy).cast("long")

    def columns(r: Column) -> Column:
        top = F.greatest(F.abs(r - 1), F.abs(r + 2)) * dy
        wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(dy))) / F.cos(F.radians(top)))))
        return F.when(top + dy >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / wide * (1 - 1e-9)))).cast("long")

    def column(r: Column, lon: Column) -> Column:
        n = columns(r)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("long"), n)

    return row, columns, column


def near(segments: DataFrame, incidents: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """Pairs of the same city within the radius, with distance_m, anywhere on the globe.

    Cells follow the latitude (grid()), so a pair lies in the same or in neighbouring ones: segments are exploded to these,
    incidents stay as they are. A cell with many incidents is dealt to several tasks.
    """
    row, columns, column = grid(radius_m)
    rows = F.explode(F.array(*(row(F.col("mid_lat")) + j for j in (-1, 0, 1))))
    s = segments.select("segment_id", "city_id", "mid_lon", "mid_lat", rows.alias("cy"))
    s = s.withColumns({"n": columns(F.col("cy")), "x": column(F.col("cy"), F.col("mid_lon"))})
    s = s.withColumn("cx", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("x") + i, F.col("n")) for i in (-1, 0, 1)))))).drop("n", "x")
    i = incidents.select("city_id", "provider_incident_id", "lon", "lat", "incident_at", "severity", row(F.col("lat")).alias("cy")).withColumn("cx", column(F.col("cy"), F.col("lon")))
    pairs = join_dealt(i, s, ["city_id", "cx", "cy"], ["provider_incident_id"]).withColumn("distance_m", geo.haversine(F.col("mid_lon"), F.col("mid_lat"), F.col("lon"), F.col("lat")))
    return pairs.where(F.col("distance_m") <= radius_m).drop("cx", "cy")


def scores(segments: DataFrame, incidents: DataFrame, at, radius_m: float = 50.0, half_life_days: float = 365.0, normalise: bool = False) -> DataFrame:
    """segment_id, city_id, incidents, raw, score. normalise: by the city's largest sum instead of capping at 1."""
    pairs = near(segments, incidents, radius_m)
    age = (F.unix_timestamp(at) - F.unix_timestamp(F.col("incident_at").cast("timestamp"))) / 86400.0
    weight = risk.incident_weight(F.col("distance_m"), age, F.col("severity"), radius_m, half_life_days)
    sums = pairs.groupBy("city_id", "segment_id").agg(F.sum(weight).alias("raw"), F.count("*").alias("incidents"))
    out = segments.select("segment_id", "city_id").join(sums, ["city_id", "segment_id"], "left")
    out = out.select("city_id", "segment_id", F.coalesce("incidents", F.lit(0)).cast("long").alias("incidents"), F.coalesce("raw", F.lit(0.0)).alias("raw"))
    if not normalise:
        return out.withColumn("score", F.least(F.lit(1.0), F.col("raw")))
    top = out.groupBy("city_id").agg(F.max("raw").alias("top"))
    return out.join(F.broadcast(top), "city_id").withColumn("score", F.when(F.col("top") > 0, F.least(F.lit(1.0), F.col("raw") / F.col("top"))).otherwise(0.0)).drop("top")  # one row a city
