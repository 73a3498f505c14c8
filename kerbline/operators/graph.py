"""Diffusion of node inputs over a graph, for all groups (city, hour) of a frame at once.

nodes: group columns, node, input. edges: city_id, src, dst, weight. Every strategy returns the group columns, node, uplift.
Hops and distances are joins and aggregates; lineage is cut through the shared folder. PageRank iterates in blocks of nodes
(pagerank.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, release
from .pagerank import pagerank

KEYS = ["city_id", "hour"]


def validate(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises for weights that are negative or not finite, inputs that are not finite, unknown targets, and empty graphs."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    n, worse = nodes.agg(F.count("*"), F.count_if(~finite(F.col("input")))).first()
    # one row for each node that is a target: how many bad weights lead to it, and whether it is known
    ends = edges.groupBy("city_id", F.col("dst").alias("node")).agg(F.count_if(~finite(F.col("weight")) | (F.col("weight") < 0)).alias("bad"))
    known = nodes.select("city_id", "node").distinct().withColumn("known", F.lit(1))
    bad, lost = ends.join(known, ["city_id", "node"], "left").agg(F.sum("bad"), F.count_if(F.col("known").isNull())).first()
    if not n or bad or worse or lost:
        raise ValueError(f"invalid graph: {n} nodes, {bad} bad weights, {worse} bad inputs, {lost} unknown targets")


def _normalised(scores: DataFrame, normalise: bool) -> DataFrame:
    if not normalise:
        return scores
    top = scores.groupBy(*KEYS).agg(F.max("uplift").alias("top"))
    return scores.join(top, KEYS).select(*KEYS, "node", F.when(F.col("top") > 0, F.col("uplift") / F.col("top")).otherwise(F.col("uplift")).alias("uplift"))


def _steps(edges: DataFrame, weight) -> DataFrame:
    return edges.select("city_id", F.col("src").alias("mid"), F.col("dst").alias("to"), weight.alias("w")).groupBy("city_id", "mid", "to").agg(F.min("w").alias("w"))


def _reach(front: DataFrame, step: DataFrame) -> DataFrame:
    reach = front.join(step, (front.city_id == step.city_id) & (front.dst == step.mid))
    return reach.select(front.city_id, "src", F.col("to").alias("dst"), (F.col("dist") + F.col("w")).alias("dist"))


def _hops(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """Fewest hops (city_id, src, dst, dist) up to k: so many joins, in one plan but for a cut every other hop."""
    step = _steps(edges, F.lit(1.0))
    front, whole = start, start
    for hop in range(1, k + 1):
        front = _reach(front, step).distinct()
        front = cut(front, "hops") if hop % 2 == 0 and hop < k else front
        whole = whole.unionByName(front)
    return whole.groupBy("city_id", "src", "dst").agg(F.min("dist").alias("dist"))


def _relaxed(edges: DataFrame, start: DataFrame, weight, rounds: int, cutoff: float) -> DataFrame:
    """Least distances (city_id, src, dst, dist) up to a cutoff; start holds distance 0."""
    step = cut(_steps(edges, weight).where(F.col("w") <= cutoff), "steps")
    best = front = cut(start, "reached")
    for _ in range(rounds):
        reach = _reach(front, step).where(F.col("dist") <= cutoff).groupBy("city_id", "src", "dst").agg(F.min("dist").alias("dist"))
        both = reach.join(best.withColumnRenamed("dist", "was"), ["city_id", "src", "dst"], "left")
        new = cut(both.where("was IS NULL OR dist < was").drop("was"), "front")
        if not new.limit(1).count():
            break
        whole = cut(best.unionByName(new).groupBy("city_id", "src", "dst").agg(F.min("dist").alias("dist")), "reached")
        release(best, front)
        best, front = whole, new
    return best


def _spread(nodes: DataFrame, dist: DataFrame, factor) -> DataFrame:
    own = nodes.select("city_id", "hour", F.col("node").alias("src"), "input").where(F.col("input") != 0)
    got = own.join(dist.where("src <> dst"), ["city_id", "src"]).groupBy("city_id", "hour", F.col("dst").alias("node")).agg(F.sum(F.col("input") * factor).alias("uplift"))
    return nodes.select(*KEYS, "node").join(got, [*KEYS, "node"], "left").select(*KEYS, "node", F.coalesce("uplift", F.lit(0.0)).alias("uplift"))


def _origins(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("input") != 0).select("city_id", F.col("node").alias("src")).distinct().select("city_id", "src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"))


def influence(nodes: DataFrame, edges: DataFrame, k: int = 2, decay: float = 0.5, normalise: bool = False) -> DataFrame:
    """Sum of decay^hops * input over the sources at most max(1, k) hops away, itself excluded; weights play no part."""
    k = max(1, k)
    dist = _hops(edges, _origins(nodes), k)
    return _normalised(_spread(nodes, dist, F.pow(F.lit(decay), F.col("dist"))), normalise)


def shortest_path(nodes: DataFrame, edges: DataFrame, radius: float = 2.0, alpha: float = 0.5, normalise: bool = False, rounds: int = 1000) -> DataFrame:
    """Sum of input * exp(-alpha * distance) over the sources within the radius; of parallel edges the shortest counts."""
    dist = _relaxed(edges, _origins(nodes), F.col("weight"), rounds, radius)
    return _normalised(_spread(nodes, dist, F.exp(-alpha * F.col("dist"))), normalise)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, strategy: Callable[..., DataFrame]) -> bool:
    """False if the name is taken."""
    if name in STRATEGIES:
        return False
    STRATEGIES[name] = strategy
    return True


def names() -> list[str]:
    return sorted(STRATEGIES)


for _name, _strategy in (("pagerank-diffusion", pagerank), ("influence-diffusion", influence), ("weighted-shortest-path", shortest_path)):
    register(_name, _strategy)


def propagate(nodes: DataFrame, edges: DataFrame, strategy: str = "pagerank-diffusion", **params) -> DataFrame:
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")  # both are read several times
    validate(nodes, edges)
    return STRATEGIES[strategy](nodes, edges, **params)
