"""Road graph: segments that share an endpoint. The OR-join of endpoint pairs is rewritten as an equi-join on exploded endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, risk


def lane_count(lanes):
    """2 for missing, empty or unparsable values."""
    return F.coalesce(F.expr("try_cast(nullif(%s, '') AS INT)" % lanes), F.lit(2))


def scoring_view(segments: DataFrame) -> DataFrame:
    """segments (coords) with the places that scorers read: start, end, centroid (mid) and the bearing from start to end."""
    s = segments.withColumns(geo.places(F.col("coords")))
    return s.withColumn("bearing", geo.bearing(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat")))


def topology(segments: DataFrame) -> DataFrame:
    """segment_id, city_id, lanes, road_class, keys and bearings of both ends of lines (coords) of any length.

    The start's bearing is that of the first leg, the end's that of the last, into the end.
    """
    a, z = (geo.vertex(F.col("coords"), n) for n in (1, -1))
    out_of, into = geo.end_azimuths(F.col("coords"))
    return segments.select(
        "segment_id", "city_id", lane_count("lanes").alias("lanes"), F.coalesce(F.nullif("highway", F.lit("")), F.lit("unclassified")).alias("road_class"),
        geo.snap(a["lon"]).alias("sx"), geo.snap(a["lat"]).alias("sy"), geo.snap(z["lon"]).alias("ex"), geo.snap(z["lat"]).alias("ey"),
        out_of.alias("start_bearing"), into.alias("end_bearing"),
    )


def ends(topo: DataFrame) -> DataFrame:
    """One row for each end of each segment: city_id, x, y, segment_id, side, bearing, lanes, road_class."""
    side = lambda n, x, y, b: F.struct(F.lit(n).alias("side"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(b).alias("bearing"))
    both = F.explode(F.array(side("start", "sx", "sy", "start_bearing"), side("end", "ex", "ey", "end_bearing")))
    return topo.select("city_id", "segment_id", "lanes", "road_class", both.alias("e")).select("city_id", "segment_id", "lanes", "road_class", "e.*")


def adjacency(topo: DataFrame, weight: float = 1.0) -> DataFrame:
    """city_id, src, dst, weight: both directions, no self-loops, one edge a pair."""
    a = ends(topo).select("city_id", "x", "y", F.col("segment_id").alias("src"))
    b = ends(topo).select("city_id", "x", "y", F.col("segment_id").alias("dst"))
    return a.join(b, ["city_id", "x", "y"]).where("src <> dst").select("city_id", "src", "dst").distinct().withColumn("weight", F.lit(weight))


def junctions(topo: DataFrame) -> DataFrame:
    """One row for each segment end: legs (own included; a loop counts twice), smallest angle (90 if none is smaller), largest lane and rank differences."""
    e = ends(topo).withColumn("rank", risk.lookup(risk.CLASS_RANK, F.col("road_class"), 2))
    other = e.select("city_id", "x", "y", *(F.col(c).alias(f"o_{c}") for c in ("segment_id", "bearing", "lanes", "rank")))
    j = e.join(other, ["city_id", "x", "y"])
    far = F.col("segment_id") != F.col("o_segment_id")
    return j.groupBy("city_id", "segment_id", "side").agg(
        F.count("*").alias("legs"),
        F.least(F.lit(90.0), F.coalesce(F.min(F.when(far, geo.angle_between(F.col("bearing"), F.col("o_bearing")))), F.lit(90.0))).alias("angle"),
        F.coalesce(F.max(F.when(far, F.abs(F.col("lanes") - F.col("o_lanes")))), F.lit(0)).alias("lane_delta"),
        F.coalesce(F.max(F.when(far, F.abs(F.col("rank") - F.col("o_rank")))), F.lit(0)).alias("rank_delta"),
    )


def junction_scores(topo: DataFrame) -> DataFrame:
    """city_id, segment_id, legs, angle, lane_delta, rank_delta, score: the worse of both ends by each signal."""
    both = junctions(topo).groupBy("city_id", "segment_id").agg(F.max("legs").alias("legs"), F.min("angle").alias("angle"), F.max("lane_delta").alias("lane_delta"), F.max("rank_delta").alias("rank_delta"))
    return both.withColumn("score", risk.junction_score(F.col("legs"), F.col("angle"), F.col("lane_delta"), F.col("rank_delta")))
