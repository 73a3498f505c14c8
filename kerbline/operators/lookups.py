"""Latest, nearest and snapped lookups over score history; every order ends in the same tie-break, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = ("inserted_at", "scoring_run_timestamp", "score_id")


def newest(columns=NEWEST) -> Column:
    return F.struct(*columns)


def latest(scores: DataFrame, key: str = "segment_id") -> DataFrame:
    """One row a key: the newest. A partial aggregate, so no key needs all its rows in one task."""
    return scores.groupBy(key).agg(F.max_by(F.struct(*[c for c in scores.columns if c != key]), newest()).alias("s")).select(key, "s.*")


def last_hour(scores: DataFrame) -> DataFrame:
    """One row a segment: the last timestamp of a run."""
    w = Window.partitionBy("segment_id").orderBy(F.desc("scoring_run_timestamp"), F.desc("inserted_at"), F.desc("score_id"))
    return scores.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_latest(segments: DataFrame, scores: DataFrame) -> DataFrame:
    return segments.join(latest(scores), "segment_id", "left")


def nearest_in_time(scores: DataFrame, at: Column, key: str = "segment_id") -> DataFrame:
    """One row a key: the smallest distance in time to ``at``, either side; ties to the newest."""
    gap = F.abs(F.unix_timestamp(F.col("scoring_run_timestamp").cast("timestamp")) - F.unix_timestamp(at))
    return scores.groupBy(key).agg(F.max_by(F.struct(*[c for c in scores.columns if c != key]), F.struct(F.negative(gap), *NEWEST)).alias("s")).select(key, "s.*")


def snap_hour(at: Column) -> Column:
    """To the hour; minute 30 and later rounds up."""
    return F.date_trunc("hour", at) + F.when(F.minute(at) >= 30, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))


def snapped(scores: DataFrame, at: Column) -> DataFrame:
    """The newest row of each segment whose timestamp equals the snapped hour."""
    return latest(scores.where(F.col("scoring_run_timestamp").cast("timestamp") == snap_hour(at)))
