"""Segment detail: the score nearest to a time with its run, local part, sub-scores, imagery, confidence and sun."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, risk, solar
from . import lookups

SUBS = ("lane_marking", "glare", "junction_complexity", "historical")


def segment_detail(segments: DataFrame, scores: DataFrame, runs: DataFrame, imagery: DataFrame, at: Column, today: Column) -> DataFrame:
    """One row for each segment. Without any score the values are the stub's, all sub-scores are stubs and there is no algorithm.

    The model's uncertainty is taken from the stored confidence; it is 1 without one. Sun angles are those of the score's time.
    """
    own = lookups.nearest_in_time(scores.drop("city_id"), at)
    run = runs.select("scoring_run_id", "city_id", F.col("propagation_algorithm_version").alias("version"))
    images = imagery.groupBy("segment_id").agg(F.count("*").alias("images"), F.max("capture_date").alias("newest"))
    s = segments.join(own, "segment_id", "left").join(run, ["scoring_run_id", "city_id"], "left").join(images, "segment_id", "left")
    scored = F.col("composite_risk").isNotNull()
    n = F.coalesce("images", F.lit(0)).cast("long")
    uncertainty = F.when(F.col("confidence").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("confidence")))
    fresh = F.when(F.col("newest").isNull(), 0.0).otherwise(risk.freshness(F.datediff(today, F.col("newest"))))
    sure, limiter = risk.confidence(fresh, risk.coverage(n), 1.0 - uncertainty)
    stub = risk.stub_hash(F.col("segment_id").cast("string"), "composite")
    azimuth, elevation = solar.position(F.col("mid_lat"), F.col("mid_lon"), F.unix_timestamp(F.col("scoring_run_timestamp").cast("timestamp")).cast("double"))
    uplift = F.coalesce("propagation_uplift", F.lit(0.0))
    value = lambda name: F.when(scored, F.col(f"sub_score_{name}")).otherwise(risk.stub_hash(F.col("segment_id").cast("string"), name)).alias(name)
    return s.select(
        "segment_id", "city_id", "osm_way_id", (~scored).alias("is_stub"), F.when(scored, F.col("composite_risk")).otherwise(stub).alias("composite_risk"),
        F.when(scored, F.greatest(F.lit(0.0), F.col("composite_risk") - uplift)).otherwise(stub).alias("local_contribution"), F.when(scored, uplift).otherwise(0.0).alias("propagation_uplift"),
        risk.version_name(F.col("version")).alias("algorithm"), risk.version_number(F.col("version")).alias("algorithm_version"), *(value(name) for name in SUBS),
        F.when(scored, F.coalesce("is_stub_lane_marking", F.lit(False))).otherwise(True).alias("is_stub_lane_marking"), n.alias("image_count"), F.col("newest").alias("newest_image"),
        sure.alias("confidence"), limiter.alias("limiter"), F.when(scored, azimuth).alias("sun_azimuth"), F.when(scored, elevation).alias("sun_elevation"), geo.bearing(*(F.col(c) for c in ("start_lon", "start_lat", "end_lon", "end_lat"))).alias("heading"),
    )
