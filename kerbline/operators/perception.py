"""Lane markings from per-image logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_score(logits: Column) -> tuple[Column, Column]:
    """Mean probability, and twice its deviation capped at 1; (0, 1) if either is not a number."""
    p = F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x.cast("double"))))
    n = F.size(logits)
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean
    spread = F.least(F.lit(1.0), 2 * F.sqrt(F.greatest(var, F.lit(0.0))))
    bad = mean.isNull() | spread.isNull() | F.isnan(mean) | F.isnan(spread)
    return F.when(bad, 0.0).otherwise(mean), F.when(bad, 1.0).otherwise(spread)


def per_image(imagery: DataFrame) -> DataFrame:
    value, spread = image_score(F.col("logits"))
    return imagery.select("segment_id", "city_id", "sample_index", "capture_date", value.alias("value"), spread.alias("uncertainty"))


def per_segment(segments: DataFrame, imagery: DataFrame) -> DataFrame:
    """segment_id, images, value, uncertainty, confidence, is_stub: mean value, largest uncertainty; without images a stub of 0."""
    own = per_image(imagery).groupBy("segment_id").agg(F.avg("value").alias("value"), F.max("uncertainty").alias("uncertainty"), F.count("*").alias("images"))
    j = segments.select("segment_id", "city_id").join(own, "segment_id", "left")
    none = F.col("images").isNull()
    return j.select(
        "segment_id", "city_id", F.coalesce("images", F.lit(0)).cast("long").alias("images"), F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("uncertainty", F.lit(0.0)).alias("uncertainty"), F.when(none, 0.0).otherwise(1.0 - F.col("uncertainty")).alias("confidence"), none.alias("is_stub"),
    )


def index(imagery: DataFrame) -> DataFrame:
    """One row a segment: its images in the order of sampling."""
    return imagery.groupBy("segment_id").agg(F.sort_array(F.collect_list(F.struct("sample_index", "provider_image_id", "capture_date", "heading_deg"))).alias("images"))
