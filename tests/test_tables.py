import datetime as dt
import json

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from kerbline import committed
from kerbline.operators import delta, scoring
from kerbline.sources import cities, imagery, incidents, objects, osm
from kerbline.streaming import incidents as streaming

LINES = "segment_id long, city_id long, highway string, lanes string, coords array<struct<lon: double, lat: double>>"
CITY = {"slug": "new-town", "name": "New Town", "bbox": [-71.2, 42.3, -71.0, 42.4], "default_zoom": 12, "timezone": "America/New_York"}


def test_city_validation(spark):
    assert cities.table(spark, [CITY]).first()["max_lat"] == 42.4
    for k, v in (("slug", "New Town"), ("bbox", [1, 2, 0, 3]), ("default_zoom", 40), ("timezone", "Mars/Base")):
        with pytest.raises(ValueError):
            cities.check(CITY | {k: v})


def test_osm_extract(spark, tmp_path):
    (tmp_path / "x.osm").write_text("""<osm><node id="1" lat="42.30" lon="-71.1"/><node id="2" lat="42.35" lon="-71.1"/><node id="3" lat="50.0" lon="3.0"/><node id="4" lat="50.1" lon="3.0"/>
<way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="lanes" v="2"/></way><way id="11"><nd ref="1"/><nd ref="2"/><tag k="building" v="yes"/></way>
<way id="12"><nd ref="3"/><nd ref="4"/><tag k="highway" v="service"/></way><way id="13"><nd ref="1"/><nd ref="99"/><tag k="highway" v="service"/></way></osm>""")
    rows = osm.read_ways(spark, str(tmp_path / "x.osm")).collect()
    assert {r["osm_way_id"] for r in rows} == {10, 12} and next(r for r in rows if r["osm_way_id"] == 10)["attrs"]["lanes"] == "2"
    assert [r["osm_way_id"] for r in osm.read_ways(spark, str(tmp_path / "x.osm"), (-71.2, 42.34, -71.0, 42.4)).collect()] == [10]


def test_incident_pages(spark, tmp_path):
    def feature(**a):
        return {"attributes": {"CRASH_NUMB": "1", "CRASH_DATE": "1700000000000", "CRASH_SEVERITY_DESCR": " Fatal injury ", "LAT": "42.1", "LON": "-71.2", "MAX_INJR_SVRTY_CL": "K"} | a, "geometry": None}

    (tmp_path / "year=2023").mkdir()
    page = {"features": [feature(), feature(CRASH_NUMB=None), feature(CRASH_NUMB="3", LAT=None), feature(CRASH_NUMB="4", CRASH_SEVERITY_DESCR="?")], "exceededTransferLimit": False}
    (tmp_path / "year=2023" / "p.json").write_text(json.dumps(page))
    rows = incidents.marshal(incidents.read_pages(spark, str(tmp_path)), "p", 1, "2023-11-14", "2023-11-14").orderBy("provider_incident_id").collect()
    assert [(r["provider_incident_id"], r["severity"]) for r in rows] == [("1", "fatal"), ("4", "unknown")] and rows[0]["metadata"] == {"MAX_INJR_SVRTY_CL": "K"}


def test_imagery_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"id": "a", "captured_at": 1700000000000, "compass_angle": 725.0}, {"id": "b", "captured_at": None, "compass_angle": 1.0}]}))
    rows = imagery.marshal(imagery.read_pages(spark, str(tmp_path / "p.json")), "p", "2023-01-01", "2023-12-31").collect()
    assert [(r["provider_image_id"], r["heading_deg"]) for r in rows] == [("a", 5.0)]


def test_objects_and_models(spark, tmp_path):
    (tmp_path / "store" / "p").mkdir(parents=True)
    for k in ("a.jpg", "b.jpg", "c.jpg"):
        (tmp_path / "store" / "p" / k).write_bytes(k.encode() * 3)
    keys = spark.createDataFrame([("p/a.jpg",), ("p/a.jpg",), ("p/x.jpg",)], "object_key string")
    rows = objects.read(spark, str(tmp_path / "store"), keys).collect()
    assert [(r["object_key"], bytes(r["content"])) for r in rows] == [("p/a.jpg", b"a.jpg" * 3)] and objects.read(spark, f"file://{tmp_path}/store").count() == 3
    (tmp_path / "weights.json").write_text(json.dumps({"bias": 2}))
    get = objects.model(spark, str(tmp_path / "weights.json"), json.loads)

    def run(batches):
        for b in batches:
            yield b.set_column(0, "id", pa.compute.add(b.column("id"), get()["bias"]))

    assert sorted(r["id"] for r in spark.range(4).mapInArrow(run, "id long").collect()) == [2, 3, 4, 5]


def test_stream_is_idempotent(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    row = {"provider": "p", "provider_incident_id": "1", "city_id": 1, "lat": 1.0, "lon": 2.0, "incident_at": "2024-01-01T00:00:00Z", "severity": "fatal"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(row | {"provider_incident_id": i}) for i in ("1", "2", "2")))
    streaming.ingest(spark, src, out, check).awaitTermination()
    (tmp_path / "in" / "b.json").write_text("\n".join(json.dumps(row | {"provider_incident_id": i}) for i in ("2", "3")))
    streaming.ingest(spark, src, out, check).awaitTermination()
    assert sorted(r["provider_incident_id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_append_needs_provenance(spark, tmp_path):
    df = spark.range(1).withColumn("city_id", F.lit(1))
    with pytest.raises(ValueError):
        scoring.append_scores(df, str(tmp_path / "s"))


def test_compare_guards(spark):
    scores = spark.createDataFrame([], "scoring_run_id string")
    runs = spark.createDataFrame([("a",)], "scoring_run_id string")
    with pytest.raises(ValueError):
        delta.compare(scores, runs, "a", "a")
    with pytest.raises(LookupError):
        delta.compare(scores, runs, "a", "b")


def test_years_are_pruned(spark, tmp_path):
    for y in (2022, 2023, 2024):
        (tmp_path / f"year={y}").mkdir()
        (tmp_path / f"year={y}" / "p.json").write_text(json.dumps({"features": [{"attributes": {"CRASH_NUMB": str(y)}, "geometry": None}], "exceededTransferLimit": False}))
    some = incidents.read_pages(spark, str(tmp_path), 2023, 2024)
    assert sorted(r["attributes"]["CRASH_NUMB"] for r in some.collect()) == ["2023", "2024"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    rows = incidents.in_years(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), 2024, 2024, "ts")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01" in plan and "LessThan(ts,2025-01-01" in plan


def test_append_scores(spark, tmp_path):
    df = spark.range(5).select(F.lit(1).alias("city_id"), F.col("id").alias("segment_id"), F.lit("r").alias("scoring_run_id"), *(F.lit("x").alias(c) for c in scoring.PROVENANCE if c != "scoring_run_id"))
    path, schema = str(tmp_path / "s"), "city_id int, segment_id long, scoring_run_id string"
    for _ in range(2):
        scoring.append_scores(df, path, {"city_id": 1})
    assert committed.read(spark, path, schema, {"city_id": 1}).count() == 10 and committed.read(spark, path, schema, {"city_id": 2}).count() == 0
    with pytest.raises(ValueError):
        scoring.append_scores(df.withColumn("osm_snapshot_date", F.lit(None).cast("string")), path)
    assert committed.read(spark, path, schema).count() == 10 and len(committed.vacuum(spark, path, older_than=-1)) == 1


def test_confidence_without_a_real_sub_score(spark):
    seg = spark.createDataFrame([(1, 9, "primary", "2", [(0.0, 0.0), (0.001, 0.0)])], LINES)
    none = spark.createDataFrame([], "segment_id long, city_id long, sample_index int, capture_date date, logits array<float>")
    crashes = spark.createDataFrame([], "city_id long, provider_incident_id string, lon double, lat double, incident_at timestamp, severity string")
    row = scoring.scoring_run(seg, none, crashes, "2025-06-21", hours=(3,), weights={"lane_marking": 1.0}).first()
    assert row["confidence"] == 0.0 and row["is_stub_lane_marking"]
    run = dict.fromkeys(scoring.PROVENANCE, "x") | {c: dt.date(2025, 1, 1) for c in ("osm_snapshot_date", "imagery_window_start", "imagery_window_end_excl")}
    stored = scoring.history(scoring.scoring_run(seg, none, crashes, "2025-06-21", hours=(3,), weights={"lane_marking": 1.0}), run, "2025-06-21").first()
    assert stored["is_stub_glare"] and stored["sub_score_glare"] == 0.0 and stored["hour_utc"] == 3 and stored["score_id"] == "x-1-3"


def test_hourly_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", 1), ("2024-01-01 10:55:00", 1), ("2024-01-01 11:00:00", 1), ("2024-01-01 10:00:00", 2)], "t string, city_id long")
    got = streaming.hourly_counts(rows.select(F.col("t").cast("timestamp").alias("incident_at"), "city_id")).collect()
    assert sorted((r["window"]["start"].hour, r["city_id"], r["n"]) for r in got) == [(10, 1, 2), (10, 2, 1), (11, 1, 1)]


def test_a_registered_sub_scorer_takes_part(spark):
    seg = spark.createDataFrame([(1, 9, "primary", "2", [(0.0, 0.0), (0.001, 0.0), (0.002, 0.0)])], LINES)
    none = spark.createDataFrame([], "segment_id long, city_id long, sample_index int, capture_date date, logits array<float>")
    crashes = spark.createDataFrame([], "city_id long, provider_incident_id string, lon double, lat double, incident_at timestamp, severity string")
    flat = lambda x: x.segments.select("city_id", "segment_id", F.lit(0.5).alias("value"), F.lit(0.25).alias("confidence"), F.lit(False).alias("is_stub"))
    assert scoring.register("surface", flat) and not scoring.register("surface", flat) and not scoring.register("glare", flat)
    try:
        row = scoring.scoring_run(seg, none, crashes, "2025-06-21", hours=(3,), weights={"surface": 0.8, "lane_marking": 0.2}).first()
    finally:
        scoring.SCORERS.pop("surface")
    assert row["local"] == pytest.approx(0.4) and row["confidence"] == 0.25 and row["is_stub_lane_marking"] and row["composite_risk"] == pytest.approx(1.4)
    assert scoring.provisional_run(seg, none, crashes, "2025-06-21", hours=(3, 12)).count() == 2
