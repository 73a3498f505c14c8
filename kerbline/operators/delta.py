"""Run-against-run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUBS = ("lane_marking", "glare", "junction_complexity", "historical")


def pair(scores: DataFrame, run_a: str, run_b: str, hour: int | None = None) -> DataFrame:
    """Rows of two runs joined on city, segment and hour of day; both sides are pruned before the join."""
    cols = ["composite_risk", "propagation_uplift", *(f"sub_score_{s}" for s in SUBS), "confidence"]

    def side(run: str, tag: str) -> DataFrame:
        own = scores.where(F.col("scoring_run_id") == run)
        own = own if hour is None else own.where(F.col("hour_utc") == hour)
        return own.select("city_id", "segment_id", "hour_utc", *(F.col(c).alias(f"{tag}_{c}") for c in cols))

    return side(run_a, "a").join(side(run_b, "b"), ["city_id", "segment_id", "hour_utc"])


def deltas(pairs: DataFrame, clamp_local: bool = True, null_as_zero: bool = True) -> DataFrame:
    """b - a of every component. Read queries clamp the local part and take missing sub-scores as 0; tiles do neither."""
    def local(t: str):
        x = F.col(f"{t}_composite_risk") - F.col(f"{t}_propagation_uplift")
        return F.greatest(F.lit(0.0), x) if clamp_local else x

    def sub(t: str, s: str):
        c = F.col(f"{t}_sub_score_{s}")
        return F.coalesce(c, F.lit(0.0)) if null_as_zero else c

    return pairs.select(
        "city_id", "segment_id", "hour_utc",
        (F.col("b_composite_risk") - F.col("a_composite_risk")).alias("composite_delta"), (local("b") - local("a")).alias("local_delta"),
        (F.col("b_propagation_uplift") - F.col("a_propagation_uplift")).alias("uplift_delta"),
        *((sub("b", s) - sub("a", s)).alias(f"{s}_delta") for s in SUBS), F.col("a_confidence"), F.col("b_confidence"),
    )


def runs_exist(runs: DataFrame, *ids: str) -> dict[str, bool]:
    found = {r["scoring_run_id"] for r in runs.where(F.col("scoring_run_id").isin(*ids)).select("scoring_run_id").distinct().collect()}  # at most as many as asked for
    return {i: i in found for i in ids}


def compare(scores: DataFrame, runs: DataFrame, run_a: str, run_b: str, hour: int = 12, page: int = 1, page_size: int = 100) -> DataFrame:
    """One page of a comparison; equal runs and unknown runs are errors."""
    if run_a == run_b:
        raise ValueError("the runs are the same")
    if not 1 <= page_size <= 1000 or page < 1:
        raise ValueError("page from 1, page_size from 1 to 1000")
    missing = [i for i, ok in runs_exist(runs, run_a, run_b).items() if not ok]
    if missing:
        raise LookupError(f"no such run: {', '.join(missing)}")
    return deltas(pair(scores, run_a, run_b, hour)).orderBy("segment_id").offset((page - 1) * page_size).limit(page_size)


def largest(changes: DataFrame, n: int = 100) -> DataFrame:
    """The n largest changes of all, with their rank; TakeOrderedAndProject, then a window over n rows."""
    from pyspark.sql import Window

    top = changes.orderBy(F.desc(F.abs("composite_delta")), "segment_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("composite_delta")), "segment_id")))


def histogram(changes: DataFrame, column: str = "composite_delta", low: float = -1.0, high: float = 1.0, bins: int = 20) -> DataFrame:
    """bin, x0, x1, n, max_n; the last bin is closed, values outside the domain are left out, empty bins stay."""
    step = (high - low) / bins
    v = F.col(column)
    edges = [low + (i + 1) * step for i in range(bins - 1)]
    which = sum(((v >= e).cast("int") for e in edges), F.lit(0))  # against the thresholds themselves, as rounding would move edge values
    counts = changes.where(v.between(low, high)).groupBy(which.alias("bin")).agg(F.count("*").alias("c"))
    spark = changes.sparkSession
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"))
    top = full.agg(F.max("n").alias("max_n"))
    return full.crossJoin(F.broadcast(top)).select("bin", (low + F.col("bin") * step).alias("x0"), (low + (F.col("bin") + 1) * step).alias("x1"), "n", "max_n")
