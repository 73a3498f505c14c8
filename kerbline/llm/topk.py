"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is quantised to integers and cut into equal segments at several resolutions. With a segment's mean m and
population deviation s over l components, Cauchy-Schwarz gives for a query q and a candidate c

    |q - c|^2 >= sum over segments of l * ((m_q - m_c)^2 + (s_q - s_c)^2),

the lower-bound distance; because |q|^2 and |c|^2 are known, the same statistics bound the inner product from above by
sum of l * (m_q * m_c + s_q * s_c). Candidates whose bound falls below the query's k-th best exact score are dropped,
coarse resolution first; exact integer scores are computed for what survives the finest one.

Work is dealt out as a grid: queries in blocks (rows) times candidates in blocks (columns). A cell holds one block of each,
both of a size that a parameter bounds, whatever the table's size; cells return k rows a query, and a window merges them.

Defined cases: vectors that are null, empty, of another length than the first one's, or holding null or non-finite
components take no part, nor do rows without an id. An id that repeats counts once, with its smallest vector. Equal
scores are ordered by the smaller id. Fewer candidates than k: all of them. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Slack for rounding in the bounds, relative to the product of the norms.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """True for a non-empty vector of finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantised(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<bigint>): floor(scale * x) of every component, one row for each id."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, each already multiplied by the root of the segment's length."""
    groups = np.array_split(np.arange(x.shape[1]), segments)
    m = np.stack([x[:, g].mean(axis=1) * np.sqrt(len(g)) for g in groups], axis=1)
    s = np.stack([x[:, g].std(axis=1) * np.sqrt(len(g)) for g in groups], axis=1)
    return m, s


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, levels: tuple[int, ...]) -> tuple[list, list, list]:
    """Each query's k best candidates of a block, exact: ids of queries, ids of candidates, scores."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    levels = tuple(sorted({min(s, c.shape[1]) for s in levels}))
    qs, cs = [segment_stats(qf, s) for s in levels], [segment_stats(cf, s) for s in levels]
    slack = SLACK * np.linalg.norm(qf, axis=1) * np.linalg.norm(cf, axis=1).max(initial=0) + SLACK
    out_q, out_c, out_s = [], [], []
    n = len(cid)
    bound = qs[0][0] @ cs[0][0].T + qs[0][1] @ cs[0][1].T + slack[:, None]
    place = np.searchsorted(cid, qid)
    for i in range(len(qid)):
        own = place[i] if place[i] < n and cid[place[i]] == qid[i] else -1
        best = bound[i]
        if own >= 0:
            best[own] = -np.inf
        left = n - (own >= 0)
        take = min(k, left)
        if not take:
            continue
        # the k most promising by the coarse bound give a first threshold
        seed = np.argpartition(-best, take - 1)[:take]
        floor = np.sort(c[seed] @ q[i])[0]
        alive = np.flatnonzero(best >= floor)
        for (qm, qd), (cm, cd) in zip(qs[1:], cs[1:], strict=True):
            if len(alive) <= 4 * k:
                break
            fine = cm[alive] @ qm[i] + cd[alive] @ qd[i] + slack[i]
            seed = alive[np.argpartition(-fine, take - 1)[:take]]
            floor = max(floor, np.sort(c[seed] @ q[i])[0])
            alive = alive[fine >= floor]
        score = c[alive] @ q[i]
        top = np.lexsort((cid[alive], -score))[:take]
        out_q += [int(qid[i])] * len(top)
        out_c += cid[alive][top].tolist()
        out_s += score[top].tolist()
    return out_q, out_c, out_s


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t["id"].to_numpy()
    v = t["v"].combine_chunks()
    flat = (v.flatten() if not isinstance(v, pa.ChunkedArray) else pa.concat_arrays([x.flatten() for x in v.chunks])).to_numpy()
    return ids, flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 1)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, query_block: int = 2048, candidate_block: int = 16384, levels: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """Both inputs as of quantised(). Returns query_id, rank, vec_id, score; a candidate with the query's id is the query's own row."""
    ship(candidates.sparkSession)
    n, width = candidates.agg(F.count("*"), F.min(F.struct("id", F.size("v").alias("w")))["w"]).first()
    candidates, queries = (d.where(F.size("v") == F.lit(width or 0)) for d in (candidates, queries))
    m = queries.count()
    rows, cols = max(1, -(-m // query_block)), max(1, -(-n // candidate_block))
    at = lambda size, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(size)).cast("int")
    q = queries.select("id", "v", at(rows, 1).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    c = candidates.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), at(cols, 2).alias("c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        (qid, qv), (cid, cv) = _matrix(left), _matrix(right)
        found: tuple[list, list, list] = ([], [], [])
        if len(cid):
            for a in range(0, len(qid), 256):  # bounds the matrix of bounds
                for have, new in zip(found, search_block(qid[a : a + 256], qv[a : a + 256], cid, cv, k, levels), strict=True):
                    have.extend(new)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    best = q.groupBy("r", "c").cogroup(c.groupBy("r", "c")).applyInArrow(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def bruteforce(vectors: dict[int, list[int]], queries: list[int], k: int) -> list[tuple[int, int, int, int]]:
    """The plain definition, for tests."""
    out = []
    for q in sorted(queries):
        found = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


