"""The hourly scoring run: registered sub-scorers, propagation, composite. Parts that don't change by the hour are computed once and joined to the hours after."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import committed
from ..functions import geo, risk, solar
from ..shared import cut
from . import graph, historical, perception, topology


@dataclass(frozen=True)
class Inputs:
    """What a sub-scorer may read."""

    segments: DataFrame
    imagery: DataFrame
    incidents: DataFrame
    topo: DataFrame
    date: str
    hours: tuple[int, ...]


#: Name to a function of Inputs that returns city_id, segment_id, hour (only if values change by the hour), value, confidence, is_stub.
SCORERS: dict[str, Callable[[Inputs], DataFrame]] = {}


def register(name: str, scorer: Callable[[Inputs], DataFrame]) -> bool:
    """False if the name is taken. A run has columns <name>, <name>_confidence and is_stub_<name> of it."""
    if name in SCORERS:
        return False
    SCORERS[name] = scorer
    return True


def _sure(df: DataFrame) -> DataFrame:
    return df.withColumns({"confidence": F.lit(1.0), "is_stub": F.lit(False)})


def glare_scores(x: Inputs) -> DataFrame:
    s = x.segments.select("city_id", "segment_id", "mid_lat", "mid_lon", F.col("bearing").alias("axis"), F.explode(F.array(*(F.lit(h) for h in x.hours))).alias("hour"))
    at = F.unix_timestamp(F.lit(f"{x.date} 00:00:00").cast("timestamp")) + F.col("hour") * 3600
    azimuth, elevation = solar.position(F.col("mid_lat"), F.col("mid_lon"), at.cast("double"))
    return _sure(s.select("city_id", "segment_id", "hour", solar.glare(geo.axis_angle(F.col("axis"), azimuth), elevation).alias("value")))


def lane_scores(x: Inputs) -> DataFrame:
    return perception.per_segment(x.segments, x.imagery).select("city_id", "segment_id", "value", "confidence", "is_stub")


def junction_scores(x: Inputs) -> DataFrame:
    return _sure(topology.junction_scores(x.topo).select("city_id", "segment_id", F.col("score").alias("value")))


def history_scores(x: Inputs) -> DataFrame:
    at = F.lit(f"{x.date} 12:00:00").cast("timestamp")
    incidents = cut(x.incidents.select("city_id", "provider_incident_id", "lon", "lat", "incident_at", "severity"), "incidents")  # read twice
    return _sure(historical.scores(x.segments, incidents, at).select("city_id", "segment_id", F.col("score").alias("value")))


for _name, _scorer in (("glare", glare_scores), ("lane_marking", lane_scores), ("junction_complexity", junction_scores), ("historical", history_scores)):
    register(_name, _scorer)


def sub_scores(x: Inputs, names: Sequence[str]) -> DataFrame:
    """One row for each segment and hour with the columns of all named sub-scorers."""
    hourly, fixed = [], []
    for name in names:
        df = SCORERS[name](x)
        keys = ["city_id", "segment_id", *(["hour"] if "hour" in df.columns else [])]
        named = df.select(*keys, F.col("value").alias(name), F.col("confidence").alias(f"{name}_confidence"), F.col("is_stub").alias(f"is_stub_{name}"))
        (hourly if "hour" in keys else fixed).append(named)
    still = x.segments.select("city_id", "segment_id")
    for df in fixed:
        still = still.join(df, ["city_id", "segment_id"], "left")
    rows = still.withColumn("hour", F.explode(F.array(*(F.lit(h) for h in x.hours))))
    for df in hourly:
        rows = rows.join(df, ["city_id", "segment_id", "hour"], "left")
    return rows


def inputs(segments: DataFrame, imagery: DataFrame, incidents: DataFrame, date: str, hours: Sequence[int]) -> Inputs:
    """segments: lines (coords); what scorers read of them is derived once, and written, as every scorer reads it."""
    view = cut(topology.scoring_view(segments), "segments")
    return Inputs(view, imagery, incidents, cut(topology.topology(view), "topology"), date, tuple(hours))


def scoring_run(segments: DataFrame, imagery: DataFrame, incidents: DataFrame, date: str, hours: Sequence[int] = tuple(range(24)), strategy: str = "pagerank-diffusion", weights: Mapping[str, float] = risk.WEIGHTS, **params) -> DataFrame:
    """One row for each segment and hour, as the score history holds them. weights: of the sub-scorers that take part."""
    x = inputs(segments, imagery, incidents, date, hours)
    local = sum((F.lit(w) * F.coalesce(name, F.lit(0.0)) for name, w in weights.items()), F.lit(0.0))
    real = F.array(*(F.when(~F.col(f"is_stub_{name}"), F.col(f"{name}_confidence")) for name in weights))
    rows = cut(sub_scores(x, list(weights)).withColumns({"local": local, "confidence": F.coalesce(F.array_min(real), F.lit(0.0))}), "sub-scores")
    nodes = rows.select("city_id", "hour", F.col("segment_id").alias("node"), F.col("local").alias("input"))
    lift = graph.propagate(nodes, topology.adjacency(x.topo), strategy, **params).select("city_id", "hour", F.col("node").alias("segment_id"), F.col("uplift").alias("propagation_uplift"))
    return rows.join(lift, ["city_id", "hour", "segment_id"]).withColumn("composite_risk", F.col("local") + F.col("propagation_uplift"))


def provisional_run(segments: DataFrame, imagery: DataFrame, incidents: DataFrame, date: str, hours: Sequence[int] = tuple(range(24)), names: Sequence[str] = ("lane_marking", "glare", "junction_complexity")) -> DataFrame:
    """The run without propagation: the mean of the sub-scores that are no stubs, and their smallest confidence."""
    rows = sub_scores(inputs(segments, imagery, incidents, date, hours), names)
    one = lambda n: F.struct(F.col(n).alias("value"), F.col(f"{n}_confidence").alias("confidence"), F.coalesce(f"is_stub_{n}", F.lit(True)).alias("stub"))
    real = F.filter(F.array(*(one(n) for n in names)), lambda s: ~s["stub"])
    mean = F.aggregate(real, F.lit(0.0), lambda a, s: a + s["value"]) / F.size(real)
    return rows.withColumns({"composite_risk": F.when(F.size(real) > 0, mean).otherwise(0.0), "confidence": F.coalesce(F.array_min(F.transform(real, lambda s: s["confidence"])), F.lit(0.0))})


#: What makes a run reproducible; no score is stored without it.
PROVENANCE = ("scoring_run_id", "scoring_run_timestamp", "perception_model_version", "osm_snapshot_date", "imagery_window_start", "imagery_window_end_excl", "propagation_algorithm_version")
#: Sub-scores that the score history has columns for, whether or not a run computes them.
STORED = ("lane_marking", "glare", "junction_complexity", "historical")
RUNS = "scoring_run_id string, city_id long, scoring_run_timestamp timestamp, perception_model_version string, osm_snapshot_date date, imagery_window_start date, imagery_window_end_excl date, propagation_algorithm_version string, notes string"
HISTORY = (
    "score_id string, segment_id long, city_id long, scoring_run_id string, hour_utc int, scoring_run_timestamp timestamp, composite_risk double, propagation_uplift double, "
    + ", ".join(f"sub_score_{n} double" for n in STORED) + ", confidence double, " + ", ".join(f"is_stub_{n} boolean" for n in STORED)
    + ", perception_model_version string, osm_snapshot_date date, imagery_window_start date, imagery_window_end_excl date, propagation_algorithm_version string, inserted_at timestamp"
)


def history(rows: DataFrame, run: Mapping, date: str) -> DataFrame:
    """Rows of a scoring run as the score history stores them; run: what the table of runs has of it.

    Of sub-scores without a scorer the value is 0 and a stub. score_id is made of run, segment and hour.
    """
    own = {f"sub_score_{n}": F.coalesce(n, F.lit(0.0)) if n in rows.columns else F.lit(0.0) for n in STORED}
    stub = {f"is_stub_{n}": F.coalesce(f"is_stub_{n}", F.lit(True)) if n in rows.columns else F.lit(True) for n in STORED}
    told = {c: F.lit(run[c]) for c in PROVENANCE}
    at = F.lit(f"{date} 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("hour"))
    new = {"scoring_run_timestamp": at, "hour_utc": F.col("hour").cast("int"), "score_id": F.concat_ws("-", "scoring_run_id", "segment_id", "hour"), "inserted_at": F.current_timestamp()}
    out = rows.withColumns(told).withColumns(own | stub | new)
    return out.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in HISTORY.split(", ")))


def complete(rows: DataFrame) -> None:
    """ValueError unless every row has its provenance."""
    missing = [c for c in PROVENANCE if c not in rows.columns]
    if missing:
        raise ValueError(f"missing provenance: {', '.join(missing)}")
    empty = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in PROVENANCE)).first().asDict()
    if any(empty.values()):
        raise ValueError(f"null provenance: {empty}")


def append_scores(rows: DataFrame, path: str, scope: Mapping | None = None) -> int:
    """Appends to the score history in one commit. Rows are computed once: what is checked is what was staged, before anyone can read it."""
    missing = [c for c in PROVENANCE if c not in rows.columns]
    if missing:
        raise ValueError(f"missing provenance: {', '.join(missing)}")
    return committed.append(rows.repartitionByRange("segment_id").sortWithinPartitions("segment_id"), path, scope, check=complete)
