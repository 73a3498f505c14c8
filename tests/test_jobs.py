"""Jobs end to end on a town of three ways."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kerbline import committed, jobs
from kerbline.operators import detail, scoring, topology
from kerbline.sources import imagery

OSM = """<osm><node id="1" lat="42.350" lon="-71.10"/><node id="2" lat="42.351" lon="-71.10"/><node id="3" lat="42.352" lon="-71.10"/><node id="4" lat="42.351" lon="-71.099"/><node id="5" lat="42.3505" lon="-71.1001"/>
<way id="10"><nd ref="1"/><nd ref="5"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="lanes" v="2"/></way><way id="11"><nd ref="2"/><nd ref="3"/><tag k="highway" v="service"/></way>
<way id="12"><nd ref="2"/><nd ref="4"/><tag k="highway" v="service"/></way></osm>"""


def test_a_town_from_files_to_scores(spark, tmp_path):
    base = str(tmp_path / "tables")
    town = {"slug": "new-town", "name": "New Town", "bbox": [-71.2, 42.3, -71.0, 42.4], "default_zoom": 12, "timezone": "America/New_York"}
    (tmp_path / "c.json").write_text(json.dumps(town))
    assert jobs.main([base, "cities", str(tmp_path / "c.json")]) == {"new-town": "inserted"}
    (tmp_path / "c.json").write_text(json.dumps(town | {"default_zoom": 13}))
    assert jobs.main([base, "cities", str(tmp_path / "c.json")]) == {"new-town": "updated"}
    with pytest.raises(LookupError):
        jobs.main([base, "seed", "nowhere", "x"])
    (tmp_path / "x.osm").write_text(OSM)
    assert jobs.main([base, "seed", "new-town", str(tmp_path / "x.osm")]) == 3 == jobs.main([base, "seed", "new-town", str(tmp_path / "x.osm")])
    (tmp_path / "pages" / "year=2025").mkdir(parents=True)
    crash = {"attributes": {"CRASH_NUMB": "1", "CRASH_DATE": "1749000000000", "CRASH_SEVERITY_DESCR": "Fatal injury", "LAT": "42.3505", "LON": "-71.10"}, "geometry": None}
    (tmp_path / "pages" / "year=2025" / "p.json").write_text(json.dumps({"features": [crash, crash], "exceededTransferLimit": False}))
    args = [base, "incidents", "new-town", str(tmp_path / "pages"), "2025-01-01", "2025-12-31"]
    assert jobs.main(args) == 1 and jobs.main(args) == 0
    jobs.main([base, "requests", "new-town", str(tmp_path / "asks"), "--max-segments", "2"])
    assert {r["segment_id"] for r in spark.read.json(str(tmp_path / "asks")).collect()} == {10, 11}
    run = jobs.main([base, "score", "new-town", "2025-06-21", "--strategy", "influence-diffusion"])
    scores = committed.read(spark, f"{base}/segment_scores", scoring.HISTORY)
    rows = scores.where(f"scoring_run_id = '{run}'").collect()
    assert len(rows) == 72 == len({r["score_id"] for r in rows}) and max(r["sub_score_historical"] for r in rows if r["segment_id"] == 10) > 0.5
    assert {r["scoring_run_timestamp"].hour for r in rows} == set(range(24)) == {r["hour_utc"] for r in rows}
    runs = committed.read(spark, f"{base}/scoring_runs", scoring.RUNS)
    assert [(r["scoring_run_id"], r["propagation_algorithm_version"]) for r in runs.collect()] == [(run, "influence-diffusion-0.1.0")]
    segments = committed.read(spark, f"{base}/road_segments", jobs.SEGMENTS)
    assert {r["segment_id"]: len(r["coords"]) for r in segments.collect()} == {10: 3, 11: 2, 12: 2}
    at, today = F.lit("2025-06-21 15:20:00").cast("timestamp"), F.lit("2025-07-01").cast("date")
    told = {r["segment_id"]: r for r in detail.segment_detail(topology.scoring_view(segments), scores, runs, jobs.read(spark, base, "imagery", jobs.IMAGERY), at, today).collect()}
    assert not told[10]["is_stub"] and told[10]["algorithm"] == "influence-diffusion" and told[10]["image_count"] == 0


def images_near(df):
    """One image at each waypoint, one that all waypoints of a segment see, one that is too old; segment 12 is refused."""
    row = lambda i, lon, lat, day: F.struct(i.alias("id"), (F.unix_timestamp(F.lit(day).cast("timestamp")) * 1000).alias("captured_at"), F.lit(-90.0).alias("compass_angle"), lon.alias("lon"), lat.alias("lat"))
    own = F.concat_ws("/", "segment_id", "sample_index")
    shared = row(F.concat(F.lit("s"), F.col("segment_id")), F.lit(-71.1), F.lit(42.352), "2025-02-01")
    some = F.array(row(own, F.col("lon"), F.col("lat"), "2025-01-05"), shared, row(F.concat(own, F.lit("old")), F.col("lon"), F.col("lat"), "2019-01-01"))
    out = df.withColumn("error", F.when(F.col("segment_id") == 12, "503")).select("segment_id", "sample_index", "error", F.explode(some).alias("i"))
    hide = lambda c: F.when(F.col("error").isNull(), F.col(f"i.{c}")).alias(c)
    return out.select("segment_id", "sample_index", *map(hide, ("id", "captured_at", "compass_angle")), F.lit(None).cast("array<double>").alias("camera_parameters"), F.lit(None).cast("string").alias("thumb_1024_url"), hide("lon"), hide("lat"), "error")


def test_images_are_committed_batch_by_batch(spark, tmp_path):
    base = str(tmp_path / "tables")
    (tmp_path / "c.json").write_text(json.dumps({"slug": "t", "name": "T", "bbox": [-71.2, 42.3, -71.0, 42.4], "default_zoom": 12, "timezone": "America/New_York"}))
    (tmp_path / "x.osm").write_text(OSM)
    jobs.seed_cities(spark, base, str(tmp_path / "c.json"))
    jobs.seed(spark, base, "t", str(tmp_path / "x.osm"))
    seen = []

    def stops(df):
        if len(seen) == 2:
            raise RuntimeError("the line is down")
        seen.append(df.count())
        return images_near(df)

    args = (spark, base, "t", "2025-01-01", "2025-12-31")
    perceive = lambda df: df.withColumn("logits", F.array(*(F.lit(float(x)) for x in range(4))).cast("array<float>"))
    with pytest.raises(Exception, match="the line is down"):
        jobs.ingest_images(*args, stops, perceive, batch=2)
    kept = jobs.read(spark, base, "imagery", jobs.IMAGERY).count()
    assert kept > 0 and seen == [2, 2]
    refused_before = jobs.read(spark, base, "image_refusals", jobs.REFUSED).count()
    all_boxes = jobs.image_requests(spark, base, "t").count()
    after = []
    jobs.ingest_images(*args, lambda df: (after.append(df.count()), images_near(df))[1], perceive, batch=2)
    assert sum(seen) + sum(after) == all_boxes + refused_before  # nothing that was answered is asked twice
    rows = jobs.read(spark, base, "imagery", jobs.IMAGERY).collect()
    assert len(rows) == len({(r["provider_image_id"], r["segment_id"]) for r in rows}) and {r["segment_id"] for r in rows} == {10, 11}
    assert {r["heading_deg"] for r in rows} == {270.0} and not any("old" in r["provider_image_id"] for r in rows)
    refused = jobs.read(spark, base, "image_refusals", jobs.REFUSED)
    n12 = jobs.image_requests(spark, base, "t").where("segment_id = 12").count()
    assert refused.select("sample_index").distinct().count() == n12
    again = []
    assert jobs.ingest_images(*args, lambda df: (again.append(df.count()), images_near(df.withColumn("segment_id", F.lit(99).cast("long")).join(df.select("sample_index"), "sample_index", "left_semi")))[1], perceive) == 0
    assert sum(again) == n12  # only what was refused
    run = jobs.score(spark, base, "t", "2025-06-21", "influence-diffusion")
    stub = {r["segment_id"]: (r["is_stub_lane_marking"], r["imagery_window_start"]) for r in committed.read(spark, f"{base}/segment_scores", scoring.HISTORY).where(f"scoring_run_id = '{run}'").collect()}
    assert {k: v[0] for k, v in stub.items()} == {10: False, 11: False, 12: True} and str(stub[10][1]) == "2025-01-05"


def test_landed_images_find_the_nearest_waypoint(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.00015, 0.0), (2, 0, 0.0001, 0.0001)], "segment_id long, sample_index int, lon double, lat double")
    images = spark.createDataFrame([("a", 0.00009, 0.0), ("b", 0.00005, 0.00005), ("c", 0.01, 0.0), ("d", None, 0.0), ("e", -0.0001, -0.0001)], "id string, lon double, lat double")
    got = {(r["id"], r["segment_id"]): r["sample_index"] for r in imagery.attach(images, imagery.waypoint_boxes(points)).collect()}
    assert got == {("a", 1): 1, ("a", 2): 0, ("b", 1): 0, ("b", 2): 0, ("e", 1): 0}
    assert "NestedLoop" not in imagery.attach(images, imagery.waypoint_boxes(points))._jdf.queryExecution().executedPlan().toString()


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v int"
    rows = lambda *xs: spark.createDataFrame(list(xs), schema)
    committed.append(rows((1, 1)), path, {"city": 1})
    with pytest.raises(ZeroDivisionError):
        committed.append(rows((2, 2)), path, {"city": 2}, check=lambda df: 1 / 0)
    committed.stage(rows((3, 3)), path)  # died before its commit
    assert [tuple(r) for r in committed.read(spark, path, schema).collect()] == [(1, 1)]
    old = committed.read(spark, path, schema)
    committed.update(spark, path, schema, lambda now: now.selectExpr("k", "v + 10 AS v"), {"city": 1})
    committed.append(rows((9, 9)), path, {"city": 2})
    assert sorted(tuple(r) for r in committed.read(spark, path, schema).collect()) == [(1, 11), (9, 9)] and [tuple(r) for r in old.collect()] == [(1, 1)]
    assert [tuple(r) for r in committed.read(spark, path, schema, version=1).collect()] == [(1, 1)]
    assert len(committed.vacuum(spark, path, keep=1, older_than=-1)) == 3 and committed.read(spark, path, schema).count() == 2


def test_writers_that_meet(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v int"
    committed.append(spark.createDataFrame([(0,)], schema), path)
    met = []

    def add(now):
        if not met:  # another writer commits while this one computes
            met.append(committed.update(spark, path, schema, lambda x: x.selectExpr("v + 100 AS v")).count())
        return now.selectExpr("v + 1 AS v")

    assert [r["v"] for r in committed.update(spark, path, schema, add).collect()] == [101]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: committed.append(spark.createDataFrame([(k,)], schema), path), range(1, 7)))
    assert sorted(r["v"] for r in committed.read(spark, path, schema).collect()) == [1, 2, 3, 4, 5, 6, 101]
    with pytest.raises(committed.Conflict):
        committed.update(spark, path, schema, lambda now: committed.append(spark.createDataFrame([(7,)], schema), path) and now, attempts=2)


def test_supervisor_resumes_and_backs_off(spark, tmp_path):
    calls, waits = [], []

    def job(name, fails):
        def run():
            calls.append(name)
            if calls.count(name) <= fails:
                raise RuntimeError("not yet")

        return run

    todo = {"a": job("a", 0), "b": job("b", 9), "c": job("c", 1)}
    assert jobs.supervise(spark, todo, str(tmp_path), sleep=waits.append) == {"a": "done", "b": "failed: not yet", "c": "done"}
    assert calls == ["a", "b", "b", "b", "c", "c"] and waits == [2.0, 4.0, 2.0]
    assert jobs.supervise(spark, todo, str(tmp_path), attempts=1, sleep=waits.append) == {"a": "done before", "b": "failed: not yet", "c": "done before"}
