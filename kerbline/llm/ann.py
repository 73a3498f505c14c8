"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node, named by their smallest id; what is found is expanded to the smallest ids of each node at the
end, so copies are exact however many there are.

Build. A node's code holds its components divided by the largest of them, in half precision, next to that scale, so vectors
of very different lengths keep their precision; final scores use the originals. The first graph is a cheap one: a few random
hyperplane trees deal the nodes into small buckets (beyond a bound split by hashed id), and a node's best there are its first
neighbours. Then NN-descent: every node introduces its neighbours (forward ones and a bounded hashed choice of reverse ones)
to one another; a pair that was not introduced before and beats the worst neighbour of one side is proposed to it, and each
node keeps its best ``degree``. An iteration is a few equi-joins and top-n windows over (node, neighbour) rows; it stops when
few neighbours are new.

Search. A query starts from its own neighbours if it is in the graph and from a fixed number of entry nodes, scores the
neighbours of its best unexpanded candidates, and repeats until no query's best change; these are rescored exactly, in
double precision.

Every row is indexed, none is sampled. Choices are by hashed ids, so results repeat. Defined cases: vectors that are null,
zero, of another length than that of the smallest id, or that hold null or non-finite components take no part; an id that
repeats counts once, with its smallest vector; equal scores are ordered by the smaller id; with fewer candidates than asked
for, or than entries, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_spread, parts, release, ship, whole_groups
from .topk import usable

EDGE = "id long, dst long, sim double"


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>), one row for each id."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def _codes(column: pa.Array, n: int) -> np.ndarray:
    """Rows of float32 from a column of half-precision codes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float16)
    return flat.reshape(n, -1).astype(np.float32) if n else np.zeros((0, 1), np.float32)


def encode(rows: DataFrame) -> DataFrame:
    """(id, scale, code binary): components divided by the vector's largest, in half precision."""
    ship(rows.sparkSession)
    width = rows.agg(F.min(F.struct("id", F.size("v").alias("w")))["w"]).first()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            m = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            scale = np.abs(m).max(axis=1)
            small = (m / scale[:, None]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scale), pa.array([x.tobytes() for x in small], pa.binary())], ["id", "scale", "code"])

    return rows.where(F.size("v") == F.lit(width or 0)).mapInArrow(run, "id long, scale double, code binary")


def best(edges: DataFrame, degree: int) -> DataFrame:
    """id, dst, sim, fresh: the best of each id; fresh: not there before. edges: the same columns, pairs may repeat."""
    one = edges.where("id <> dst").groupBy("id", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "dst")
    return one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= degree)


def first_graph(codes: DataFrame, n: int, width: int, trees: int = 4, bucket: int = 128, keep: int = 10, seed: int = 7) -> DataFrame:
    """Proposed edges from random-hyperplane buckets."""
    bits = max(0, math.ceil(math.log2(max(1, n / bucket))))
    planes = np.random.default_rng(seed).standard_normal((trees, bits, width)).astype(np.float32)
    weights = (1 << np.arange(bits, dtype=np.int64))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            x = _codes(b.column("code"), b.num_rows)
            for t in range(trees):
                where = ((x @ planes[t].T > 0) * weights).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(where), b.column("id"), b.column("scale"), b.column("code")], ["t", "b", "id", "scale", "code"])

    rows = codes.mapInArrow(deal, "t int, b long, id long, scale double, code binary")
    size = rows.groupBy("t", "b").agg(F.ceil(F.count("*") / (2 * bucket)).cast("int").alias("nb"))
    rows = rows.join(size, ["t", "b"]).withColumn("s", F.pmod(F.xxhash64("id", "t"), F.col("nb")).cast("long")).drop("nb")
    cell = ["t", "b", "s"]

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for t in whole_groups(batches, cell):
            cols = [t[c].to_numpy() for c in cell]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = [*np.flatnonzero(new).tolist(), t.num_rows]
            ids, scale, x = t["id"].to_numpy(), t["scale"].to_numpy(), _codes(t["code"], t.num_rows)
            for s, e in zip(starts, starts[1:], strict=False):
                k = min(keep, e - s - 1)
                if k < 1:
                    continue
                sim = (x[s:e] @ x[s:e].T) * scale[s:e]
                np.fill_diagonal(sim, -np.inf)
                near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[s:e], k)), pa.array(ids[s:e][near].reshape(-1)), pa.array(np.take_along_axis(sim, near, 1).reshape(-1))], ["id", "dst", "sim"])

    dealt = rows.repartition(parts(codes.sparkSession), *cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(pair, EDGE)


def introduce(graph: DataFrame, codes: DataFrame, forward: int, backward: int, keep: int) -> DataFrame:
    """Proposed edges among the neighbours of each vector: neighbours of neighbours."""
    forth = graph.where(F.col("rn") <= forward).select(F.col("id").alias("at"), F.col("dst").alias("id"), "fresh")
    w = Window.partitionBy("at").orderBy(F.xxhash64("at", "id"), "id")
    back = graph.where(F.col("rn") <= forward).select(F.col("dst").alias("at"), "id", "fresh").withColumn("k", F.row_number().over(w)).where(F.col("k") <= backward).drop("k")
    members = forth.unionByName(back).groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("id").agg(F.min("sim").alias("worst"))
    known = members.join(codes.join(worst, "id", "left"), "id")
    groups = known.groupBy("at").agg(F.collect_list(F.struct("id", "fresh", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"), "scale", "code")).alias("m"))  # at most forward + backward of them

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                m = b.slice(start, 500).column("m")
                flat = m.flatten()
                ids, fresh, worst, scale = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "fresh", "worst", "scale"))
                x = _codes(flat.field("code"), len(flat))
                out: tuple[list, list, list] = ([], [], [])
                at = 0
                for n in m.value_lengths().to_pylist():
                    own = slice(at, at + n)
                    at += n
                    if n < 2 or not fresh[own].any():
                        continue
                    sim = (x[own] @ x[own].T) * scale[own]
                    f = fresh[own].astype(bool)
                    sim[~(f[:, None] | f[None, :])] = -np.inf
                    np.fill_diagonal(sim, -np.inf)
                    sim[sim <= worst[own][:, None]] = -np.inf
                    k = min(keep, n - 1)
                    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                    s = np.take_along_axis(sim, near, 1)
                    i, j = np.nonzero(np.isfinite(s))
                    out[0].append(ids[own][i])
                    out[1].append(ids[own][near[i, j]])
                    out[2].append(s[i, j])
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["id", "dst", "sim"])

    return groups.mapInArrow(run, EDGE)


def build(codes: DataFrame, degree: int = 56, forward: int = 40, backward: int = 24, keep: int = 8, rounds: int = 8, settle: float = 0.02, **start) -> DataFrame:
    """The neighbour graph: id, dst, sim, fresh, rn. codes: as of encode(), cheap to read again."""
    ship(codes.sparkSession)
    n, size = codes.agg(F.count("*"), F.max(F.octet_length("code"))).first()
    old = F.lit(1).alias("fresh")
    graph = cut(best(first_graph(codes, n, (size or 2) // 2, **start).withColumn("fresh", old), degree), "graph")
    for _ in range(rounds):
        proposed = introduce(graph, codes, forward, backward, keep).withColumn("fresh", F.lit(1))
        new = cut(best(graph.select("id", "dst", "sim", F.lit(0).alias("fresh")).unionByName(proposed), degree), "graph")
        release(graph)
        graph = new
        total, fresh = graph.agg(F.count("*"), F.sum("fresh")).first()
        codes.sparkSession.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the rounds before
        if not fresh or fresh < settle * total:
            break
    return graph


def _score(pairs: DataFrame, asked: DataFrame, codes: DataFrame) -> DataFrame:
    """q, dst, sim of (q, dst) pairs by their codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            sim = np.einsum("ij,ij->i", _codes(b.column("qcode"), b.num_rows), _codes(b.column("code"), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("dst"), pa.array(sim * b.column("scale").to_numpy())], ["q", "dst", "sim"])

    full = pairs.join(codes.withColumnRenamed("id", "dst"), "dst").join(asked.select(F.col("id").alias("q"), F.col("code").alias("qcode")), "q")
    return full.select("q", "dst", "scale", "code", "qcode").mapInArrow(run, "q long, dst long, sim double")


def search(graph: DataFrame, codes: DataFrame, asked: DataFrame, pool: int = 96, width: int = 24, hops: int = 8, entries: int = 64, k: int = 20) -> DataFrame:
    """q, dst, sim: the best ``pool`` nodes for each query node, itself aside. asked: as codes; hops end when no query's k best change."""
    doors = [F.lit(r["id"]) for r in codes.select("id").orderBy(F.xxhash64("id"), "id").limit(entries).collect()]
    start = asked.select(F.col("id").alias("q"), F.explode(F.array(*doors).cast("array<bigint>")).alias("dst"))
    own = graph.join(asked.select("id"), "id", "left_semi").select(F.col("id").alias("q"), "dst", "sim", F.lit(0).alias("done"))
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "dst")

    def top(rows: DataFrame) -> DataFrame:
        one = rows.where("q <> dst").groupBy("q", "dst").agg(F.max("sim").alias("sim"), F.max("done").alias("done"))
        return one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= pool)

    state = cut(top(own.unionByName(_score(start, asked, codes).withColumn("done", F.lit(0)))), "beam")
    for _ in range(hops):
        turn = F.row_number().over(Window.partitionBy("q", "done").orderBy(F.desc("sim"), "dst"))
        ranked = state.drop("rn").withColumn("turn", turn)
        front = ranked.where((F.col("done") == 0) & (F.col("turn") <= width)).select("q", F.col("dst").alias("id"))
        reached = front.join(graph.select("id", "dst"), "id").select("q", "dst").where("q <> dst").distinct().join(state.select("q", "dst"), ["q", "dst"], "left_anti")
        after = ranked.withColumn("done", F.when(F.col("turn") <= width, 1).otherwise(F.col("done"))).drop("turn")
        new = cut(top(after.unionByName(_score(reached, asked, codes).withColumn("done", F.lit(0)))), "beam")
        release(state)
        state = new
        if not state.where((F.col("done") == 0) & (F.col("rn") <= k)).limit(1).count():
            break
    return state.select("q", "dst", "sim")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest(rows: DataFrame, asked, k: int = 20, searching: dict | None = None, **building) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. rows: as of vectors(); asked: a predicate on rows that picks the queries."""
    rows = cut(rows, "vectors")
    equal = cut(rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")), "equal")
    member = cut(join_spread(rows, equal, ["v"], ["id"]).select("id", "node"), "members")
    nodes = equal.select(F.col("node").alias("id"), "v")
    codes = cut(encode(nodes), "codes")
    graph = build(codes, **building)
    queries = member.join(rows.where(asked).select("id"), "id")
    asked_nodes = cut(queries.groupBy("node").agg(F.count("*").alias("n")), "asked")
    wanted = codes.join(asked_nodes.select(F.col("node").alias("id")), "id", "left_semi")
    found = search(graph, codes, wanted, **({"pool": max(96, 4 * k), "k": k} | (searching or {}))).select("q", "dst")
    found = found.unionByName(wanted.select(F.col("id").alias("q"), F.col("id").alias("dst")))  # copies of the query itself
    v = lambda key, name: nodes.select(F.col("id").alias(key), F.col("v").alias(name))
    exact = found.join(v("dst", "cv"), "dst").join(v("q", "qv"), "q").select("q", "dst", dot(F.col("qv"), F.col("cv")).alias("score"))
    first = member.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("rn") <= k + 1)
    each = exact.join(first.select(F.col("node").alias("dst"), "id"), "dst")
    each = each.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rn") <= k + 1)
    lists = each.groupBy(F.col("q").alias("node")).agg(F.array_sort(F.collect_list(F.struct("rn", "id", "score"))).alias("best"))  # k + 1 of them
    lists = cut(lists.join(asked_nodes, "node"), "lists")
    out = join_spread(queries.select("node", F.col("id").alias("query_id")), lists, ["node"], ["query_id"])
    out = out.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
