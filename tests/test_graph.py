import random

import pytest

from kerbline.operators import graph, index, pagerank


def frames(spark, inputs, edges):
    nodes = spark.createDataFrame([(1, 0, i, float(x)) for i, x in enumerate(inputs)], "city_id long, hour int, node long, input double")
    return nodes, spark.createDataFrame([(1, a, b, float(w)) for a, b, w in edges], "city_id long, src long, dst long, weight double")


def values(df):
    return {r["node"]: r["uplift"] for r in df.collect()}


def both(*pairs):
    return [(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in pairs]


def plain_pagerank(inputs, edges, d, rounds=100):
    n, total = len(inputs), sum(inputs)
    t = [x / total for x in inputs]
    out = [sum(w for a, _, w in edges if a == u) for u in range(n)]
    pi = t[:]
    for _ in range(rounds):
        lost = sum(pi[u] for u in range(n) if not out[u])
        new = [(1 - d) * t[v] + d * lost * t[v] for v in range(n)]
        for a, b, w in edges:
            if out[a]:
                new[b] += d * pi[a] * w / out[a]
        pi = new
    return pi


def test_influence_chain_and_star(spark):
    assert values(graph.propagate(*frames(spark, [1, 1, 1], both((0, 1), (1, 2))), "influence-diffusion", k=2)) == pytest.approx({0: 0.75, 1: 1.0, 2: 0.75})
    star = values(graph.propagate(*frames(spark, [1] * 5, both((0, 1), (0, 2), (0, 3), (0, 4))), "influence-diffusion", k=2))
    assert star == pytest.approx({0: 2.0, 1: 1.25, 2: 1.25, 3: 1.25, 4: 1.25})


def test_pagerank_teleport_only_and_sum(spark):
    n, e = frames(spark, [1, 3], both((0, 1)))
    assert values(graph.pagerank(n, e, damping=0.0, normalise=False)) == pytest.approx({0: 0.25, 1: 0.75})
    rng = random.Random(4)
    edges = [(rng.randrange(12), rng.randrange(12), rng.uniform(0, 3)) for _ in range(25)]
    inputs = [rng.uniform(0, 2) for _ in range(12)]
    got = values(graph.pagerank(*frames(spark, inputs, edges), normalise=False))
    assert sum(got.values()) == pytest.approx(1, abs=1e-10)
    assert [got[i] for i in range(12)] == pytest.approx(plain_pagerank(inputs, edges, 0.85), abs=1e-9)


@pytest.mark.parametrize(("block", "depth", "rounds"), [(1000, 10, 30), (5, 3, 7), (2, 1, 3)])
def test_blocks_of_any_size_agree(spark, block, depth, rounds):
    """Cities and hours at once, with dangling nodes, loops, parallel edges and hours that some nodes lack."""
    rng = random.Random(block)
    nodes, edges, want = [], [], {}
    for city, n in ((1, 23), (2, 9), (3, 1)):
        own = [(rng.randrange(n), rng.randrange(n), rng.choice([0.0, 1.0, 2.5])) for _ in range(2 * n)]
        own = [e for e in own if e[0] % 6]  # every sixth node is dangling
        edges += [(city, a + 100, b + 100, w) for a, b, w in own]
        for hour in (0, 7, 13):
            x = [rng.choice([0.0, 1.0, 3.0]) + (v == 0) for v in range(n)]
            missing = {v for v in range(n) if hour == 7 and v % 4 == 1}
            x = [0.0 if v in missing else y for v, y in enumerate(x)]
            nodes += [(city, hour, v + 100, y) for v, y in enumerate(x) if v not in missing]
            for v, y in enumerate(plain_pagerank(x, own, 0.85, rounds)):
                if v not in missing:
                    want[city, hour, v + 100] = y
    n = spark.createDataFrame(nodes, "city_id long, hour int, node long, input double").repartition(3)
    e = spark.createDataFrame(edges, "city_id long, src long, dst long, weight double")
    got = {(r["city_id"], r["hour"], r["node"]): r["uplift"] for r in graph.pagerank(n, e, normalise=False, rounds=rounds, block=block, depth=depth).collect()}
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("edges", "passes"), [(both((0, 1), (1, 2), (2, 3), (3, 4)), 2), ([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (2, 4, 1.0)], 4)])
def test_a_pass_for_dangling_mass_only_where_edges_lead_to_it(spark, monkeypatch, edges, passes):
    """Node 5 has no edge at all; in the second graph an edge leads to node 4, which has none of its own."""
    run, seen = pagerank._rounds, []
    monkeypatch.setattr(pagerank, "_rounds", lambda *a: (seen.append(a[4]), run(*a))[1])
    inputs = [1.0, 0.0, 2.0, 0.5, 0.0, 3.0]
    got = values(graph.pagerank(*frames(spark, inputs, edges), normalise=False, rounds=6, block=2, depth=3))
    assert [got[i] for i in range(6)] == pytest.approx(plain_pagerank(inputs, edges, 0.85, 6), abs=1e-12)
    assert len(seen) == passes and sum(seen) == 2


@pytest.mark.parametrize("most", [0, 1, 3, 32])
def test_steps_add_up_the_edges_of_hubs(most):
    import numpy as np

    rng = np.random.default_rng(most)
    u, v, p = rng.integers(0, 40, 400), np.sort(rng.integers(0, 40, 400) ** 2 // 40), rng.random(400)
    fall = np.argsort(-np.bincount(v, minlength=40), kind="stable")
    place = np.argsort(fall)
    x, new, want = rng.random((3, 40)), np.empty((3, 40)), np.zeros((3, 40))
    for a, b, w in zip(place[u], place[v], p, strict=True):
        want[:, b] += w * x[:, a]
    pagerank.steps(place[u], place[v], p, most)(x, new)
    assert new == pytest.approx(want, abs=1e-12)


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(c, rng.randrange(10**9)) for c in (1, 1, 1, 2, 3) for _ in range(70)]
    df = spark.createDataFrame(rows, "c int, node long")
    for parts in (1, 5):
        got = {(r["c"], r["node"]): (r["place"], r["total"]) for r in index.numbered(df.repartition(parts), ["c"], ["node"])[0].collect()}
        assert got == {(c, x): (i, len(own)) for c in (1, 2, 3) for own in [sorted(x for k, x in rows if k == c)] for i, x in enumerate(own)}
    assert index.numbered(df.limit(0), ["c"], ["node"])[0].count() == 0


def test_zero_inputs(spark):
    assert set(values(graph.pagerank(*frames(spark, [0, 0], both((0, 1)))).orderBy("node")).values()) == {0.0}


def test_shortest_path_takes_the_lighter_of_parallel_edges(spark):
    import math

    got = values(graph.propagate(*frames(spark, [1, 0, 0], [(0, 1, 2.0), (0, 1, 0.5), (1, 2, 1.0)]), "weighted-shortest-path", radius=2.0, alpha=1.0))
    assert got == pytest.approx({0: 0.0, 1: math.exp(-0.5), 2: math.exp(-1.5)})


def test_validation_and_registry(spark):
    for inputs, edges in (([1.0], [(0, 0, -1)]), ([float("nan")], [(0, 0, 1)]), ([1.0], [(0, 5, 1)])):
        with pytest.raises(ValueError):
            graph.propagate(*frames(spark, inputs, edges))
    assert not graph.register("pagerank-diffusion", graph.pagerank)
    assert graph.names() == sorted(graph.names())
