"""Percentiles, the distance grid, tile bytes, clustered files and table functions against plain definitions."""

import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from kerbline import committed, layout, table_functions
from kerbline.functions import geo
from kerbline.operators import historical, percentiles, vector_tiles


# -- percentiles --


def test_percentiles_of_odd_groups(spark):
    rng = random.Random(1)
    groups = {1: [rng.gauss(0, 1) for _ in range(999)], 2: [5.0] * 40, 3: [1.0], 4: [0.0] * 500 + [1e300, -1e300, 1e-300], 5: [float(x) for x in range(10)], 6: [rng.choice([0.1, 0.2]) for _ in range(301)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [(1, None), (7, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    for few, bins in ((1, 3), (50, 1024)):
        got = {r["g"]: r for r in percentiles.summary(df, ["g"], {"p95": 0.95, "p0": 0.0}, few=few, bins=bins).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            xs = sorted(xs)
            assert (got[g]["p50"], got[g]["p95"], got[g]["p0"], got[g]["most"]) == (statistics.median(xs), xs[max(1, math.ceil(len(xs) * 0.95)) - 1], xs[0], xs[-1])
    wanted = spark.createDataFrame([(5, 10), (5, 11), (5, 0), (9, 1)], "g int, rank long")
    assert [tuple(r) for r in percentiles.ranks(df, ["g"], wanted).collect()] == [(5, 10, 9.0)]


# -- distances --


def haversine(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [50.0, 120_000.0])
def test_distances_anywhere(spark, radius):
    rng = random.Random(int(radius))
    places = [(0.0, 0.0), (180.0, 10.0), (-180.0, -45.0), (17.0, 78.3), (30.0, 89.9999), (-100.0, -89.9999), (0.0, 90.0), (12.0, -90.0), (179.9999, 66.0)]
    step = math.degrees(radius / geo.EARTH_M)

    def around(p):
        lat = max(-90.0, min(90.0, p[1] + rng.uniform(-1.2, 1.2) * step))
        lon = p[0] + rng.uniform(-1.2, 1.2) * step / max(0.001, math.cos(math.radians(lat))) if rng.random() < 0.8 else rng.uniform(-180, 180)
        return ((lon + 180) % 360 - 180, lat)

    seg = [(i, 1, *around(places[i % len(places)])) for i in range(150)]
    inc = [(1, f"i{k}", *around(places[k % len(places)])) for k in range(300)]
    s = spark.createDataFrame(seg, "segment_id long, city_id long, mid_lon double, mid_lat double")
    i = spark.createDataFrame(inc, "city_id long, provider_incident_id string, lon double, lat double").withColumns({"incident_at": F.current_timestamp(), "severity": F.lit("fatal")})
    got = historical.near(s, i, radius).select("segment_id", "provider_incident_id").collect()
    want = {(a[0], b[1]) for a in seg for b in inc if haversine(a[2:], b[2:]) <= radius}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_a_hot_cell_is_dealt(spark):
    s = spark.createDataFrame([(1, 1, 5.0, 50.0), (2, 1, 5.0001, 50.0)], "segment_id long, city_id long, mid_lon double, mid_lat double")
    i = spark.range(6000).select((F.pmod(F.col("id"), F.lit(1)) + 1).alias("city_id"), F.col("id").cast("string").alias("provider_incident_id"), (F.pmod(F.col("id"), F.lit(1)) + 5.0).alias("lon"), (F.pmod(F.col("id"), F.lit(1)) + 50.0).alias("lat"), F.current_timestamp().alias("incident_at"), F.lit("x").alias("severity"))
    near = historical.near(s, i)
    assert near.count() == 12000 and "NestedLoop" not in near._jdf.queryExecution().executedPlan().toString()


# -- tile bytes, read back by a reader of their own --


def read_varint(data, at):
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def read_message(data):
    at, out = 0, []
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 0:
            v, at = read_varint(data, at)
        elif key & 7 == 1:
            v, at = struct.unpack("<d", data[at : at + 8])[0], at + 8
        else:
            n, at = read_varint(data, at)
            v, at = data[at : at + n], at + n
        out.append((key >> 3, v))
    return out


def read_numbers(data):
    at, out = 0, []
    while at < len(data):
        n, at = read_varint(data, at)
        out.append(n)
    return out


def unzigzag(n):
    return (n >> 1) ^ -(n & 1)


def read_value(data):
    (k, v), = read_message(data)
    return {1: lambda: v.decode(), 3: lambda: v, 5: lambda: v, 6: lambda: unzigzag(v), 7: lambda: bool(v)}[k]()


def read_lines(data):
    ns, at, pos, lines = read_numbers(data), 0, (0, 0), []
    while at < len(ns):
        kind, count = ns[at] & 7, ns[at] >> 3
        at += 1
        for _ in range(count):
            pos = (pos[0] + unzigzag(ns[at]), pos[1] + unzigzag(ns[at + 1]))
            at += 2
            if kind == 1:
                lines.append([pos])
            else:
                assert kind == 2
                lines[-1].append(pos)
    return lines


def read_tile(data):
    (k, body), = read_message(data)
    assert k == 3
    m = read_message(body)
    assert dict(m)[15] == 2 and dict(m)[5] == 4096
    keys, values = [v.decode() for k, v in m if k == 3], [read_value(v) for k, v in m if k == 4]
    out = {}
    for k, v in m:
        if k == 2:
            f = dict(read_message(v))
            tags = read_numbers(f[2])
            out[f[1]] = ({keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, read_lines(f[4]))
            assert f[3] == 2
    return dict(m)[1].decode(), out


def test_tile_bytes(spark):
    rng = random.Random(2)
    lines = [[(rng.uniform(-71.12, -71.08), rng.uniform(42.33, 42.37))] for _ in range(30)]
    for line in lines:
        for _ in range(rng.randint(1, 12)):
            line.append((line[-1][0] + rng.uniform(-0.01, 0.01), line[-1][1] + rng.uniform(-0.01, 0.01)))
    lines.append([(-71.1, 42.35), (-71.1 + 1e-9, 42.35)])  # no length in whole units
    rows = [(i, line, rng.choice(["primary", "Straße", None]), rng.choice([0.5, 0.25, -1.0]), -i if i % 2 else i, i % 3 == 0) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "segment_id long, coords array<struct<lon: double, lat: double>>, highway string, risk double, k int, stub boolean")
    tiled = vector_tiles.tiled(df, 14)
    tiles = {(r["x"], r["y"]): r for r in vector_tiles.encode(tiled, "roads", "segment_id", ["highway", "risk", "k", "stub"]).collect()}
    n = 0
    for r in tiled.collect():
        name, features = read_tile(tiles[(r["x"], r["y"])]["tile"])
        assert name == "roads" and len(features) == tiles[(r["x"], r["y"])]["features"]
        legs = [((g["x1"], g["y1"]), (g["x2"], g["y2"])) for g in r["geometry"] if (g["x1"], g["y1"]) != (g["x2"], g["y2"])]
        if not legs:
            assert r["segment_id"] not in features
            continue
        told, drawn = features[r["segment_id"]]
        assert [(a, b) for line in drawn for a, b in zip(line, line[1:], strict=False)] == legs
        assert told == {a: r[a] for a in ("highway", "risk", "k", "stub") if r[a] is not None}
        n += 1
    assert n > 30 and any(len(line) > 3 for r in tiles.values() for _, drawn in read_tile(r["tile"])[1].values() for line in drawn)


def test_clipping_places_each_vertex_once(spark):
    """Latitudes are projected for the two borders of a box (there, and in the filter that Spark derives of it) and once for the vertices."""
    df = spark.createDataFrame([(1, [(-71.1, 42.35), (-71.09, 42.36)])], "segment_id long, coords array<struct<lon: double, lat: double>>")
    plan = vector_tiles.tiled(df, 14)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("TAN(") <= 5 and plan.upper().count("ROUND(") == 4


# -- files along the curve --


def test_files_that_a_box_cannot_meet_are_not_read(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "segment_id long, min_lon double, min_lat double, max_lon double, max_lat double"
    rows = spark.range(20_000).select(F.col("id").alias("segment_id"), (F.rand(1) * 0.5 - 71.5).alias("min_lon"), (F.rand(2) * 0.5 + 42).alias("min_lat"))
    rows = rows.select("*", (F.col("min_lon") + 0.001).alias("max_lon"), (F.col("min_lat") + 0.001).alias("max_lat"))
    layout.write(rows, path, 64, {"city_id": 1})
    committed.append(rows.limit(5), path, {"city_id": 2})
    box = (-71.3, 42.2, -71.27, 42.23)
    got = layout.read_box(spark, path, schema, box, {"city_id": 1})
    want = rows.where("max_lon >= -71.3 AND min_lon <= -71.27 AND max_lat >= 42.2 AND min_lat <= 42.23")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in want.select("segment_id").collect()) and want.count() > 10
    own = {"city_id": 1}
    assert len(layout.files_of(spark, path, (-180, -90, 180, 90), own)) > 50
    sizes = [len(layout.files_of(spark, path, (-71.5, 42.0, -71.5 + w, 42.0 + w), own)) for w in (0.5, 0.25, 0.1, 0.02)]
    assert sizes[0] > 2 * sizes[1] > 2 * sizes[2] and sizes[3] <= 4
    assert layout.read_box(spark, path, schema, (0, 0, 1, 1), own).count() == 0 and len(layout.files_of(spark, path, box)) > len(layout.files_of(spark, path, box, own))
    assert "PushedFilters: [IsNotNull(max_lon)" in got._jdf.queryExecution().executedPlan().toString()
    layout.write(rows.limit(10), path, 4, {"city_id": 1})
    assert committed.read(spark, path, schema, own).count() == 10


def test_morton(spark):
    got = spark.createDataFrame([(-180.0, -90.0), (180.0, 90.0), (0.0, -90.0), (-180.0, 0.0), (12.5, -33.25), (500.0, 0.0)], "lon double, lat double").select(layout.morton(F.col("lon"), F.col("lat")).alias("z")).collect()
    unit = lambda v, low, width: int(max(0, min(2**31 - 1, (v - low) / width * 2**31)))
    weave = lambda a, b: sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(31))
    assert [r["z"] for r in got] == [weave(unit(a, -180, 360), unit(b, -90, 180)) for a, b in ((-180, -90), (180, 90), (0, -90), (-180, 0), (12.5, -33.25), (500, 0))]


# -- SQL --


def test_tile_functions(spark):
    cities = spark.createDataFrame([(1, "a"), (2, "b")], "city_id long, slug string")
    box = geo.tile_box(14, 4956, 6059)
    inside, outside = (box[0] + 1e-4, box[1] + 1e-4), (box[0] - 1.0, box[1])
    segments = spark.createDataFrame([(k, c, None, *p, *p) for k, c, p in ((1, 1, inside), (2, 1, outside), (3, 2, inside), (4, 1, inside))], "segment_id long, city_id long, highway string, min_lon double, min_lat double, max_lon double, max_lat double")
    score = lambda i, s, run, h, risk, at: (f"{i}", s, 1, run, h, f"2025-06-21 {h:02}:00:00", risk, *[risk] * 3, None, at)
    rows = [score(1, 1, "r1", 12, 0.25, "2025-07-01"), score(2, 1, "r2", 12, 0.5, "2025-07-02"), score(3, 1, "r1", 13, 0.75, "2025-07-03")]
    columns = "score_id string, segment_id long, city_id long, scoring_run_id string, hour_utc int, t string, composite_risk double, sub_score_lane_marking double, sub_score_glare double, sub_score_junction_complexity double, sub_score_historical double, i string"
    scores = spark.createDataFrame(rows, columns).withColumns({"scoring_run_timestamp": F.col("t").cast("timestamp"), "inserted_at": F.col("i").cast("timestamp")})
    table_functions.register(spark, cities, segments, scores)
    tile = lambda *a: {r["segment_id"]: r for r in spark.sql(f"SELECT * FROM road_segments_tile(14, 4956, 6059, {', '.join(a)})").collect()}
    at_noon = tile("'a'", "TIMESTAMP '2025-06-21 12:20:00'")
    assert set(at_noon) == {1, 4} and at_noon[1]["composite_risk"] == 0.5 and at_noon[4]["is_stub"] and at_noon[1]["highway"] == "unknown" and at_noon[1]["historical"] == 0.0
    assert tile("'a'", "TIMESTAMP '2025-06-21 12:31:00'")[1]["composite_risk"] == 0.75 == tile("'a'")[1]["composite_risk"]
    assert tile("'nowhere'") == {} and set(tile("'b'")) == {3}
    rows = spark.sql("SELECT * FROM road_segments_tile_delta(14, 4956, 6059, 'r1', 'r2', 'a')").collect()
    assert [(r["segment_id"], r["composite_delta"], r["historical_delta"]) for r in rows] == [(1, 0.25, 0.0)]
    wide = spark.sql("SELECT v.z, count(*) AS n FROM VALUES (14, 4956, 6059), (1, 0, 0) AS v(z, x, y), LATERAL road_segments_tile(v.z, v.x, v.y, 'a', NULL) GROUP BY 1").collect()
    assert {r["z"]: r["n"] for r in wide} == {14: 2, 1: 3}
