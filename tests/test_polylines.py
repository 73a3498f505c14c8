"""Lines of 2 to 200 vertices against plain definitions, and WKB in both byte orders."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import scoring, topology

LINES = "segment_id long, city_id long, highway string, lanes string, coords array<struct<lon: double, lat: double>>"


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(3)
    out = []
    for k, n in enumerate([2, 3, 4, 5, 9, 50, 200]):
        at = [(rng.uniform(-71.2, -71.1), rng.uniform(42.3, 42.4))]
        for _ in range(n - 1):
            at.append((at[-1][0] + rng.uniform(-1e-3, 1e-3), at[-1][1] + rng.uniform(-1e-3, 1e-3)))
        out.append(at)
    return out


@pytest.fixture(scope="module")
def frame(spark, lines):
    return spark.createDataFrame([(i, 1, "primary", "2", [tuple(p) for p in line]) for i, line in enumerate(lines)], LINES).repartition(3)


def plain_azimuth(a, b):
    return math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360


def test_places_and_bearings(frame, lines):
    view = {r["segment_id"]: r for r in topology.scoring_view(frame).collect()}
    topo = {r["segment_id"]: r for r in topology.topology(frame).collect()}
    for i, line in enumerate(lines):
        legs = [(a, b, math.dist(a, b)) for a, b in zip(line, line[1:], strict=False)]
        whole = sum(x for _, _, x in legs)
        mid = [sum((a[k] + b[k]) / 2 * x for a, b, x in legs) / whole for k in (0, 1)]
        assert (view[i]["mid_lon"], view[i]["mid_lat"]) == pytest.approx(mid, abs=1e-12)
        assert (view[i]["start_lon"], view[i]["end_lat"]) == (line[0][0], line[-1][1])
        assert topo[i]["start_bearing"] == pytest.approx(plain_azimuth(line[0], line[1]))
        assert topo[i]["end_bearing"] == pytest.approx(plain_azimuth(line[-2], line[-1]))
    box = frame.select("segment_id", *(c.alias(n) for n, c in geo.bounds(F.col("coords")).items())).collect()
    assert all(r["min_lon"] == min(p[0] for p in lines[r["segment_id"]]) and r["max_lat"] == max(p[1] for p in lines[r["segment_id"]]) for r in box)


def test_interpolation_runs_along_all_legs(frame, lines):
    got = frame.select("segment_id", *(geo.interpolate(F.col("coords"), F.lit(t)).alias(f"t{k}") for k, t in enumerate((0.0, 0.3, 1.0)))).collect()
    for r in got:
        line = lines[r["segment_id"]]
        left = 0.3 * sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
        for a, b in zip(line, line[1:], strict=False):
            if left <= math.dist(a, b):
                t = left / math.dist(a, b)
                assert (r["t1"]["lon"], r["t1"]["lat"]) == pytest.approx((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])), abs=1e-9)
                break
            left -= math.dist(a, b)
        assert tuple(r["t0"]) == line[0] and tuple(r["t2"]) == line[-1]


def test_wkb_both_ways(spark, frame, lines):
    rows = frame.select("segment_id", geo.to_wkb("coords").alias("w")).withColumn("back", geo.from_wkb("w")).collect()
    for r in rows:
        line = lines[r["segment_id"]]
        assert bytes(r["w"]) == struct.pack(f">BII{2 * len(line)}d", 0, 2, len(line), *(x for p in line for x in p))
        assert [tuple(p) for p in r["back"]] == line
    little = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    with_srid = struct.pack("<BIII4d", 1, 0x20000002, 4326, 2, 1.0, 2.0, 3.0, 4.0)
    odd = [little, with_srid, None, b"", little[:-1], struct.pack("<BI2d", 1, 1, 1.0, 2.0), b"\x05" + little[1:]]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(odd)], "k int, w binary")
    got = {r["k"]: r["p"] for r in df.select("k", geo.from_wkb("w").alias("p")).collect()}
    assert [tuple(p) for p in got[0]] == [tuple(p) for p in got[1]] == [(1.0, 2.0), (3.0, 4.0)] and all(got[k] is None for k in range(2, 7))
    bad = spark.createDataFrame([(0, None), (1, []), (2, [(1.0, 2.0)]), (3, [(1.0, 2.0), (None, 1.0)]), (4, [(1.0, 2.0), (3.0, 4.0)])], "k int, c array<struct<lon: double, lat: double>>")
    got = {r["k"]: r["w"] for r in bad.select("k", geo.to_wkb("c").alias("w")).collect()}
    assert [got[k] is None for k in range(5)] == [True, True, True, True, False]


def test_coincident_vertices(spark):
    s = spark.createDataFrame([(1, 1, None, None, [(1.0, 2.0), (1.0, 2.0)])], LINES)
    r = topology.topology(s).first()
    assert (r["start_bearing"], r["end_bearing"], r["lanes"], r["road_class"]) == (0.0, 0.0, 2, "unclassified")
    assert topology.scoring_view(s).first()["mid_lon"] == 1.0


def test_what_scorers_read_of_lines_is_written_once(frame, lines):
    """Every scorer reads it, and centroids take long."""
    x = scoring.inputs(frame, None, None, "2025-06-21", (12,))
    for df in (x.segments, x.topo):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "lambda" not in plan
    want = {r["segment_id"]: r for r in topology.scoring_view(frame).collect()}
    assert {r["segment_id"]: r for r in x.segments.collect()} == want and x.topo.count() == len(lines)
