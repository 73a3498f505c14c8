"""Personalised PageRank of graphs of any size: blocks of nodes that iterate on their own and exchange ranks every few rounds.

Nodes of a city get dense numbers, and so many consecutive ones are a block. A block's task holds its own nodes and its zone, the
nodes from which own ones are reached in up to ``depth`` steps, with the edges between them; so it can go ``depth`` rounds
before it needs ranks of other blocks again. A block that nothing leads into from outside needs none at all, and then all rounds
take one pass: that is how small cities run, by the same path as large ones.

Rounds are linear but for the mass of dangling nodes, one number for each round, city and hour. So the passes run on the powers of the
transition alone: a first series of them adds up what each power leaves on dangling nodes, from which the weight of each power
in the result follows, and a second series adds up the powers by these weights. Where no edge leads to a dangling node, as between
roads, which lead both ways, only the first power leaves something there, and the first series is left out.

A task holds the edges that lead into its block's zone. Junctions of roads have few, so that is a small multiple of the nodes; a graph
with hubs wants smaller blocks and less depth, and the in-edges of a single hub still meet in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut, release, ship
from .index import numbered

BLOCK = 100_000  # nodes; a task's arrays hold this many rows, its zone besides, for the hours of a part


def shares(edges: DataFrame) -> DataFrame:
    """city_id, u, v, p: parallel edges add up, and what leaves a node adds up to 1. Nodes whose edges all weigh 0 have none."""
    out = edges.groupBy("city_id", F.col("src").alias("u")).agg(F.sum("weight").alias("out"))
    pairs = edges.groupBy("city_id", F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.sum("weight").alias("w"))
    return pairs.join(out, ["city_id", "u"]).where("out > 0").select("city_id", "u", "v", (F.col("w") / F.col("out")).alias("p"))


def zones(home: DataFrame, links: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, bool]:
    """home: city_id, node, block. links: city_id, u, v, p, bu, bv. Returns the nodes (city_id, block, node, far) and edges
    (city_id, block, u, v, p) of each block's zone, and whether no zone goes beyond its block."""
    own = home.select("city_id", "block", "node", F.lit(0).alias("far"))
    if links.where("bu <> bv").isEmpty():
        return own, links.select("city_id", F.col("bv").alias("block"), "u", "v", "p"), True
    into = links.select("city_id", "u", "bu", F.col("v").alias("node"))
    met, rings = links.where("bu <> bv").select("city_id", F.col("bv").alias("block"), F.col("u").alias("node")), []
    for far in range(1, depth + 1):
        met = met.distinct()
        if rings:
            met = met.join(_all(rings), ["city_id", "block", "node"], "left_anti")
        new = cut(met.withColumn("far", F.lit(far)), "zone")
        if new.isEmpty():
            break
        rings.append(new)
        met = new.join(into, ["city_id", "node"]).where("bu <> block").select("city_id", "block", F.col("u").alias("node"))  # only what borders on a block is followed
    zone = cut(own.unionByName(_all(rings)), "zone")
    inner = zone.where(F.col("far") < depth).select("city_id", "block", F.col("node").alias("v"))
    edges = cut(links.select("city_id", "u", "v", "p").join(inner, ["city_id", "v"]).select("city_id", "block", "u", "v", "p"), "zone")
    release(*rings)
    return zone, edges, False


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def steps(u, v, p, most: int = 32):
    """A function of two tables (x, new), a row for each hour, that writes to new the sums of p * x[u] by v; nodes have falling in-degrees.

    The k-th edge into each node is in the k-th layer, so a layer adds a stretch of numbers to the first nodes. What hubs have
    beyond ``most`` layers is added up by runs.
    """
    import numpy as np

    by = np.argsort(v, kind="stable")
    u, v, p = u[by], v[by], p[by]
    runs = lambda v: np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    first = runs(v)
    at = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    layers = [(u[here], p[here]) for here in (np.flatnonzero(at == k) for k in range(min(most, at.max(initial=-1) + 1)))]
    rest = np.flatnonzero(at >= most)
    ru, rv, rp = u[rest], v[rest], p[rest]
    rfirst = runs(rv)
    held = np.empty(len(first))

    def step(x, new) -> None:
        new.fill(0.0)
        for row, out in zip(x, new, strict=True):
            for lu, lp in layers:
                part = np.take(row, lu, out=held[: len(lu)], mode="clip")  # with a mode, as the default copies first
                part *= lp
                out[: len(lu)] += part
            if len(rv):
                out[rv[rfirst]] += np.add.reduceat(row[ru] * rp, rfirst)

    return step


def _rounds(zone: DataFrame, edges: DataFrame, state: DataFrame, many: int, final: bool, damping: float, told: DataFrame) -> DataFrame:
    """Runs ``many`` rounds in every block. state: city_id, part, node, x, and if final acc. told: city_id, part, and if final the weights
    of these rounds; they come once for a block, with its edges. Returns rows of nodes (x after the rounds, acc) and, with node null, of blocks (mass on dangling nodes before each)."""
    ship(zone.sparkSession)

    def block(n, e):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = n.num_rows
        if not rows:
            return pa.table({k: pa.array([], t) for k, t in schema})
        width = len(n["x"][0])
        order = np.argsort(n["node"].to_numpy(), kind="stable")
        once, e = e.filter(pc.is_null(e["u"])), e.filter(pc.is_valid(e["u"]))
        u, v = (np.searchsorted(n["node"].to_numpy()[order], e[k].to_numpy()) for k in ("u", "v"))
        fall = np.argsort(-np.bincount(v, minlength=rows), kind="stable")  # nodes by falling in-degree
        order, place = order[fall], np.empty(rows, np.int64)
        place[fall] = np.arange(rows)
        step = steps(place[u], place[v], damping * e["p"].to_numpy())
        ids, own, dangling = (n[k].to_numpy()[order] for k in ("node", "own", "dangling"))
        table = lambda k: np.ascontiguousarray(n[k].combine_chunks().flatten().to_numpy().reshape(rows, -1)[order].T)
        x, new = table("x"), np.empty((width, rows))
        acc = table("acc") if final else None
        weight = once["p"].to_numpy()[np.argsort(once["v"].to_numpy())].reshape(many, width) if final else None
        lost = np.flatnonzero(own & dangling)
        mass = np.zeros((many, width))
        for k in range(many):
            mass[k] = x[:, lost].sum(axis=1)
            if final:
                acc += weight[k][:, None] * x
            step(x, new)
            x, new = new, x
        listed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a[:, own].T.ravel()), width).cast(pa.list_(pa.float64()))
        m, none = int(own.sum()), pa.nulls(1, pa.list_(pa.float64()))
        back = lambda a: pa.concat_arrays([listed(a), none]) if a is not None else pa.nulls(m + 1, pa.list_(pa.float64()))
        told = [pa.array([n["city_id"][0].as_py()] * (m + 1), pa.int64()), pa.array([n["part"][0].as_py()] * (m + 1), pa.int32()), pa.array([*ids[own].tolist(), None], pa.int64())]
        left = pa.concat_arrays([pa.nulls(m, pa.list_(pa.float64())), pa.array([mass.ravel().tolist()], pa.list_(pa.float64()))])
        return pa.Table.from_arrays([*told, back(x), back(acc), left], names=[k for k, _ in schema])

    import pyarrow as pa

    schema = [("city_id", pa.int64()), ("part", pa.int32()), ("node", pa.int64()), ("x", pa.list_(pa.float64())), ("acc", pa.list_(pa.float64())), ("mass", pa.list_(pa.float64()))]
    keys = ["city_id", "part", "block"]
    left = zone.join(state, ["city_id", "node"]).withColumn("own", F.col("far") == 0)
    left = left.select(*keys, "node", "own", "dangling", "x", *(["acc"] if final else []))
    right = edges.join(F.broadcast(told.select("city_id", "part")), "city_id").select(*keys, "u", "v", "p")  # a few rows a city
    if final:
        own = zone.select("city_id", "block").distinct().join(told, "city_id")
        # as rows without u: Arrow's writer takes long over a column of arrays that are mostly null
        right = right.unionByName(own.select(*keys, F.lit(None).cast("long").alias("u"), F.posexplode("weights").alias("v", "p")).withColumn("v", F.col("v").cast("long")))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "city_id long, part int, node long, x array<double>, acc array<double>, mass array<double>")


def weights(mass: list[float], width: int, damping: float) -> list[float]:
    """Weight of each power in the result of as many rounds as there are masses, flat like these; the power after the last counts 1."""
    import numpy as np

    left = np.array(mass).reshape(-1, width)
    c = np.zeros_like(left)  # what teleports in each round
    for k in range(len(left)):
        lost = left[k] + (c[k - 1 :: -1][:k] * left[:k]).sum(axis=0) if k else left[0]
        c[k] = 1 - damping + damping * lost
    return c[::-1].ravel().tolist()


def _masses(zone: DataFrame, edges: DataFrame, start: DataFrame, spans: list[tuple[int, int]], damping: float, clock: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """city_id, part, mass: what each power of the transition leaves on dangling nodes, by round and hour; and what was stored for it."""
    state, masses, last = start.select("city_id", "part", "node", "x"), [], []
    for k, many in spans:
        done = cut(_rounds(zone, edges, state, many, False, damping, clock), "powers")
        masses.append(done.where("node IS NULL").select("city_id", "part", F.posexplode("mass").alias("i", "m"), F.lit(k).alias("k")))
        state = done.where("node IS NOT NULL").select("city_id", "part", "node", "x")
        last.append(done)
    mass = masses[0]
    for m in masses[1:]:
        mass = mass.unionByName(m)
    mass = mass.groupBy("city_id", "part", "k", "i").agg(F.sum("m").alias("m")).groupBy("city_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "i", "m"))), lambda s: s["m"]).alias("mass"))  # rounds times hours numbers
    return mass, last


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, normalise: bool = True, rounds: int = 100, tolerance: float = 1e-12, block: int = BLOCK, depth: int = 10, hours: int = 6) -> DataFrame:
    """Personalised PageRank whose teleport is the input; dangling mass teleports; a city and hour without input is 0.

    Rounds end where the next would change less than the tolerance whatever the graph, as a power of the damping. normalise: divided
    by the largest of each city and hour.
    """
    rounds = min(rounds, max(1, math.ceil(math.log(tolerance) / math.log(damping)))) if 0 < damping < 1 else rounds if damping else 1
    part = F.floor(F.col("hour") / hours).cast("int").alias("part")
    share = cut(shares(edges), "shares")
    placed, stored = numbered(nodes.select("city_id", F.col("node").cast("long")).distinct(), ["city_id"], ["node"])
    out = share.select("city_id", F.col("u").alias("node")).distinct().withColumn("live", F.lit(True))
    home = placed.select("city_id", "node", F.floor(F.col("place") / block).cast("long").alias("block")).join(out, ["city_id", "node"], "left")
    home = cut(home.select("city_id", "node", "block", F.col("live").isNull().alias("dangling")), "home")
    at = lambda end, name: home.select("city_id", F.col("node").alias(end), F.col("block").alias(name))
    links = cut(share.join(at("u", "bu"), ["city_id", "u"]).join(at("v", "bv"), ["city_id", "v"]), "links")
    zone, inner, closed = zones(home, links, depth)
    zone = zone.join(home.select("city_id", "node", "dangling"), ["city_id", "node"])

    total = nodes.groupBy("city_id", "hour").agg(F.sum("input").alias("total"))
    given = nodes.select("city_id", "hour", part, F.col("node").cast("long").alias("node"), "input").join(total, ["city_id", "hour"])
    given = given.withColumn("t", F.when(F.col("total") != 0, F.col("input") / F.col("total")).otherwise(0.0))
    clock = cut(given.groupBy("city_id", "part").agg(F.sort_array(F.collect_set("hour")).alias("hours")), "clock")  # a few numbers a row
    given = given.groupBy("city_id", "hour", "part", "node").agg(F.sum("t").alias("t"))
    told = given.groupBy("city_id", "part", "node").agg(F.map_from_entries(F.collect_list(F.struct(F.col("hour"), F.col("t")))).alias("by_hour"))
    lined: Column = F.transform("hours", lambda h: F.coalesce(F.try_element_at("by_hour", h), F.lit(0.0)))
    every = home.select("city_id", "node").join(clock, "city_id").join(told, ["city_id", "part", "node"], "left")  # nodes without a row of some hour pass ranks on
    start = cut(every.select("city_id", "part", "node", "hours", lined.alias("x")), "start")

    step = rounds if closed else depth
    spans = [(k, min(step, rounds - k)) for k in range(0, rounds, step)]
    sinks = home.where("dangling").select("city_id", F.col("node").alias("v"))
    if links.join(sinks, ["city_id", "v"], "left_semi").isEmpty():  # then only the first power, what teleports, is there
        lost = start.join(sinks.withColumnRenamed("v", "node"), ["city_id", "node"]).select("city_id", "part", F.posexplode("x").alias("i", "m"))
        lost = lost.groupBy("city_id", "part", "i").agg(F.sum("m").alias("m")).groupBy("city_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("lost"))  # hours numbers
        every = F.sequence(F.lit(0), rounds * F.size("hours") - 1)
        mass = clock.join(lost, ["city_id", "part"], "left").select("city_id", "part", F.transform(every, lambda i: F.coalesce(F.try_element_at("lost", i), F.lit(0.0))).alias("mass"))
        last = []
    else:
        mass, last = _masses(zone, inner, start, spans, damping, clock)
    weigh = F.arrow_udf(lambda m, w: _weigh(m, w, damping), "array<double>")
    plan = cut(mass.join(clock, ["city_id", "part"]).select("city_id", "part", F.size("hours").alias("width"), weigh("mass", F.size("hours")).alias("weights")), "weights")
    release(*last)

    state = start.select("city_id", "part", "node", "x", F.transform("x", lambda v: v * 0.0).alias("acc"))
    for k, many in spans:
        own = plan.select("city_id", "part", F.slice("weights", F.col("width") * k + 1, F.col("width") * many).alias("weights"))
        done = cut(_rounds(zone, inner, state, many, True, damping, own).where("node IS NOT NULL"), "sums")
        state = done.select("city_id", "part", "node", "x", "acc")
    pi = state.join(start.select("city_id", "part", "node", "hours"), ["city_id", "part", "node"]).select("city_id", "part", "node", F.explode(F.arrays_zip("hours", F.zip_with("acc", "x", lambda a, b: a + b).alias("pi"))).alias("z"))
    pi = pi.select("city_id", F.col("z.hours").alias("hour"), "node", F.col("z.pi").alias("uplift"))
    asked = nodes.select("city_id", "hour", F.col("node").cast("long").alias("node"))
    out = pi.join(asked, ["city_id", "hour", "node"], "left_semi")
    if normalise:
        top = out.groupBy("city_id", "hour").agg(F.max("uplift").alias("top"))
        out = out.join(top, ["city_id", "hour"]).withColumn("uplift", F.when(F.col("top") > 0, F.col("uplift") / F.col("top")).otherwise(F.col("uplift"))).drop("top")
    out = cut(out, "rank")
    release(share, home, links, clock, start, plan, *stored)
    return out


def _weigh(mass, width, damping: float):
    import pyarrow as pa

    return pa.array([weights(m, w, damping) for m, w in zip(mass.to_pylist(), width.to_pylist(), strict=True)], pa.list_(pa.float64()))
