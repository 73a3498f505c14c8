"""The engine's tables as deterministic views of the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.risk import lookup

#: View name to SQL, in order of their dependence.
VIEWS = {
    "v_cities": """
SELECT CAST(r_regionkey AS BIGINT) AS city_id,
       lower(replace(r_name, ' ', '-')) AS slug, r_name AS name,
       -71.16e0 + 0.5e0 * r_regionkey AS min_lon, 42.35e0 AS min_lat,
       -71.11e0 + 0.5e0 * r_regionkey AS max_lon, 42.41e0 AS max_lat,
       12 AS default_zoom,
       CASE r_regionkey WHEN 0 THEN 'Africa/Lagos' WHEN 1 THEN 'America/New_York'
            WHEN 2 THEN 'Asia/Kolkata' WHEN 3 THEN 'Europe/Berlin' ELSE 'Asia/Dubai' END AS timezone
FROM region""",
    "v_road_segments": """
SELECT segment_id, city_id, segment_id AS osm_way_id, n0, n1, start_lon, start_lat, coords,
       list_sum(list_transform(legs, lambda g: (g.a.lon + g.b.lon) / 2e0 * g.l)) / list_sum(list_transform(legs, lambda g: g.l)) AS mid_lon,
       list_sum(list_transform(legs, lambda g: (g.a.lat + g.b.lat) / 2e0 * g.l)) / list_sum(list_transform(legs, lambda g: g.l)) AS mid_lat,
       end_lon, end_lat,
       CASE segment_id % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'tertiary' WHEN 2 THEN 'secondary'
            WHEN 3 THEN 'primary' WHEN 4 THEN 'trunk' WHEN 5 THEN 'motorway' WHEN 6 THEN 'service' END AS highway,
       CASE WHEN segment_id % 17 = 0 THEN '2;3' WHEN segment_id % 13 = 0 THEN ''
            WHEN segment_id % 11 = 0 THEN NULL ELSE CAST(1 + segment_id % 4 AS STRING) END AS lanes
FROM (SELECT *, list_transform(range(1, len(coords)), lambda i: {'a': coords[i], 'b': coords[i + 1],
         'l': sqrt(power(coords[i + 1].lon - coords[i].lon, 2) + power(coords[i + 1].lat - coords[i].lat, 2))}) AS legs
FROM (SELECT *, list_transform(range(n_points), lambda i: {
         'lon': CASE WHEN i = n_points - 1 THEN end_lon ELSE start_lon + (end_lon - start_lon) * i / (n_points - 1) END,
         'lat': CASE WHEN i = 0 THEN start_lat WHEN i = n_points - 1 THEN end_lat
                ELSE start_lat + (end_lat - start_lat) * i / (n_points - 1) + 0.0001e0 * ((segment_id + 3 * i) % 5 - 2) END}) AS coords
FROM (
  SELECT segment_id, city_id, n0, n1,
         CASE WHEN segment_id % 97 = 0 THEN 200 ELSE 2 + segment_id % 8 END AS n_points,
         -71.16e0 + 0.5e0 * city_id + 0.001e0 * (n0 % 50) AS start_lon,
         42.35e0 + 0.001e0 * floor(n0 / 50) AS start_lat,
         -71.16e0 + 0.5e0 * city_id + 0.001e0 * (n1 % 50) AS end_lon,
         42.35e0 + 0.001e0 * floor(n1 / 50) AS end_lat
  FROM (
    SELECT c_custkey AS segment_id, CAST(n_regionkey AS BIGINT) AS city_id,
           CAST(floor(c_custkey / 10) AS BIGINT) AS n0,
           CAST(floor(c_custkey / 10) AS BIGINT) + 1 + c_custkey % 3 AS n1
    FROM customer JOIN nation ON c_nationkey = n_nationkey) q0) q1) q2) q3""",
    "v_incidents": """
SELECT 'synthetic' AS provider, CAST(e.event_id AS STRING) AS provider_incident_id, s.city_id,
       s.mid_lat + 0.00001e0 * (e.user_id % 60) AS lat, s.mid_lon AS lon, e.ts AS incident_at,
       CASE e.event_type WHEN 'error' THEN 'fatal' WHEN 'purchase' THEN 'injury'
            WHEN 'click' THEN 'property_damage_only' WHEN 'view' THEN 'property_damage_only'
            ELSE 'unknown' END AS severity
FROM (SELECT x.*, x.event_id % n.n_seg AS seg FROM events x CROSS JOIN (SELECT count(*) AS n_seg FROM customer) n) e
JOIN v_road_segments s ON e.seg = s.segment_id""",
    "v_segment_imagery": """
SELECT s.segment_id, s.city_id, 'synthetic' AS provider, CAST(e.vec_id AS STRING) AS provider_image_id,
       CAST(floor(e.vec_id / e.n_seg) AS INT) AS sample_index,
       DATE '2024-01-01' - CAST(e.vec_id % 1500 AS INT) AS capture_date,
       CAST(e.vec_id * 37 % 360 AS DOUBLE) AS heading_deg, e.embedding AS logits
FROM (SELECT x.*, n.n_seg, x.vec_id % n.n_seg AS seg FROM embeddings x CROSS JOIN (SELECT count(*) AS n_seg FROM customer) n) e
JOIN v_road_segments s ON e.seg = s.segment_id""",
    "v_segment_scores": """
SELECT r.o_orderkey AS score_id, r.segment_id, s.city_id,
       concat(CAST(s.city_id AS STRING), '-', r.run_label) AS scoring_run_id, r.hour_utc,
       CASE r.hour_utc WHEN 0 THEN TIMESTAMP '2025-06-21 00:00:00' WHEN 6 THEN TIMESTAMP '2025-06-21 06:00:00'
            WHEN 12 THEN TIMESTAMP '2025-06-21 12:00:00' ELSE TIMESTAMP '2025-06-21 18:00:00' END AS scoring_run_timestamp,
       0.35e0 * r.sub_glare + 0.30e0 * r.sub_lane + 0.20e0 * r.sub_junction
         + 0.15e0 * coalesce(r.sub_historical, 0e0) + r.propagation_uplift AS composite_risk,
       r.propagation_uplift, r.sub_lane AS sub_score_lane_marking, r.sub_glare AS sub_score_glare,
       r.sub_junction AS sub_score_junction_complexity, r.sub_historical AS sub_score_historical,
       r.confidence, r.is_stub_lane_marking, r.inserted_at
FROM (SELECT o.*, row_number() OVER (PARTITION BY segment_id, run_label, hour_utc
                                     ORDER BY inserted_at DESC, o_orderkey DESC) AS rn
      FROM (
  SELECT o_orderkey, o_custkey AS segment_id, o_orderdate AS inserted_at,
         CASE WHEN year(o_orderdate) % 2 = 0 THEN 'A' ELSE 'B' END AS run_label,
         CAST(o_orderkey % 4 * 6 AS INT) AS hour_utc,
         (o_orderkey % 101) / 100e0 AS sub_lane, (o_orderkey % 89) / 88e0 AS sub_glare,
         (o_custkey % 97) / 96e0 AS sub_junction,
         CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE (o_custkey % 83) / 82e0 END AS sub_historical,
         (o_orderkey % 71) / 70e0 AS propagation_uplift, (o_orderkey % 51) / 50e0 AS confidence,
         o_orderkey % 7 = 0 AS is_stub_lane_marking
  FROM orders) o) r
JOIN v_road_segments s ON r.segment_id = s.segment_id WHERE r.rn = 1""",
    "v_scoring_runs": """
SELECT scoring_run_id, city_id, max(inserted_at) AS scoring_run_timestamp,
       'synthetic-0.1.0' AS perception_model_version, DATE '2025-06-01' AS osm_snapshot_date,
       DATE '2020-01-01' AS imagery_window_start, DATE '2024-01-02' AS imagery_window_end_excl,
       'pagerank-diffusion-0.1.0' AS propagation_algorithm_version
FROM v_segment_scores GROUP BY scoring_run_id, city_id""",
}


def with_views(sql: str) -> str:
    """sql with the views that it needs as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if v in text and v not in need:
                add(VIEWS[v])
                need.append(v)

    add(sql)
    if not need:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if recursive else len("WITH") :]
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads},\n{body}"
    return f"WITH {heads}\n{body}"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cities(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("r_regionkey")
    zones = {0: "Africa/Lagos", 1: "America/New_York", 2: "Asia/Kolkata", 3: "Europe/Berlin"}
    return table(spark, d, "region").select(
        key.cast("long").alias("city_id"),
        F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("slug"),
        F.col("r_name").alias("name"),
        (-71.16 + 0.5 * key).alias("min_lon"),
        F.lit(42.35).alias("min_lat"),
        (-71.11 + 0.5 * key).alias("max_lon"),
        F.lit(42.41).alias("max_lat"),
        F.lit(12).alias("default_zoom"),
        lookup(zones, key, "Asia/Dubai").alias("timezone"),
    )


def road_segments(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("city_id"))
    s = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = s.repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # a million rows may be one row group of a few MB, hence one task; a given number is not coalesced
    s = s.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # the nation table has 25 rows at every scale
    n0 = F.floor(F.col("c_custkey") / 10).cast("long")
    s = s.select(F.col("c_custkey").alias("segment_id"), "city_id", n0.alias("n0"), (n0 + 1 + F.col("c_custkey") % 3).alias("n1"))
    lon = lambda n: -71.16 + 0.5 * F.col("city_id") + 0.001 * (F.col(n) % 50)
    lat = lambda n: 42.35 + 0.001 * F.floor(F.col(n) / 50)
    s = s.select("*", lon("n0").alias("start_lon"), lat("n0").alias("start_lat"), lon("n1").alias("end_lon"), lat("n1").alias("end_lat"))
    k = F.col("segment_id")
    many = F.when(k % 97 == 0, 200).otherwise((2 + k % 8).cast("int"))
    s = s.withColumn("n_points", many)
    n = F.col("n_points")
    wave = lambda i: 0.0001 * ((k + 3 * i) % 5 - 2)
    along = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / (n - 1)
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.when(i == n - 1, F.col("end_lon")).otherwise(along("start_lon", "end_lon", i)).alias("lon"),
        F.when(i == 0, F.col("start_lat")).when(i == n - 1, F.col("end_lat")).otherwise(along("start_lat", "end_lat", i) + wave(i)).alias("lat"),
    ))
    s = s.withColumn("coords", line)
    mid = geo.centroid(F.col("coords"))
    classes = {0: "residential", 1: "tertiary", 2: "secondary", 3: "primary", 4: "trunk", 5: "motorway", 6: "service"}
    lanes = F.when(k % 17 == 0, "2;3").when(k % 13 == 0, "").when(k % 11 == 0, F.lit(None)).otherwise((1 + k % 4).cast("string"))
    return s.select(
        k, "city_id", k.alias("osm_way_id"), "n0", "n1", "start_lon", "start_lat",
        "coords", mid["lon"].alias("mid_lon"), mid["lat"].alias("mid_lat"),
        "end_lon", "end_lat", lookup(classes, k % 8, None).alias("highway"), lanes.alias("lanes"),
    )


def incidents(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").count()
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", (F.col("event_id") % n).alias("seg"))
    j = e.join(road_segments(spark, d), F.col("seg") == F.col("segment_id"))
    kinds = {"error": "fatal", "purchase": "injury", "click": "property_damage_only", "view": "property_damage_only"}
    return j.select(
        F.lit("synthetic").alias("provider"), F.col("event_id").cast("string").alias("provider_incident_id"), "city_id",
        (F.col("mid_lat") + 0.00001 * (F.col("user_id") % 60)).alias("lat"), F.col("mid_lon").alias("lon"),
        F.col("ts").alias("incident_at"), lookup(kinds, F.col("event_type"), "unknown").alias("severity"),
    )


def segment_imagery(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").count()
    v = F.col("vec_id")
    e = table(spark, d, "embeddings").select("*", (v % n).alias("seg"))
    return e.join(road_segments(spark, d), F.col("seg") == F.col("segment_id")).select(
        "segment_id", "city_id", F.lit("synthetic").alias("provider"), v.cast("string").alias("provider_image_id"),
        F.floor(v / n).cast("int").alias("sample_index"), F.date_sub(F.lit("2024-01-01").cast("date"), (v % 1500).cast("int")).alias("capture_date"),
        (v * 37 % 360).cast("double").alias("heading_deg"), F.col("embedding").alias("logits"),
    )


def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    k, c, when = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    o = table(spark, d, "orders").select(
        k, c.alias("segment_id"), when.alias("inserted_at"),
        F.when(F.year(when) % 2 == 0, "A").otherwise("B").alias("run_label"), (k % 4 * 6).cast("int").alias("hour_utc"),
        ((k % 101) / 100.0).alias("sub_lane"), ((k % 89) / 88.0).alias("sub_glare"), ((c % 97) / 96.0).alias("sub_junction"),
        F.when(k % 29 == 0, F.lit(None)).otherwise((c % 83) / 82.0).alias("sub_historical"),
        ((k % 71) / 70.0).alias("propagation_uplift"), ((k % 51) / 50.0).alias("confidence"), (k % 7 == 0).alias("is_stub_lane_marking"),
    )
    w = Window.partitionBy("segment_id", "run_label", "hour_utc").orderBy(F.desc("inserted_at"), F.desc("o_orderkey"))
    o = o.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    s = road_segments(spark, d).select("segment_id", "city_id")
    r = o.join(s, "segment_id")
    noon = F.expr("TIMESTAMP_NTZ '2025-06-21 00:00:00'") + F.make_interval(hours=F.col("hour_utc"))
    local = 0.35 * F.col("sub_glare") + 0.30 * F.col("sub_lane") + 0.20 * F.col("sub_junction") + 0.15 * F.coalesce("sub_historical", F.lit(0.0))
    return r.select(
        k.alias("score_id"), "segment_id", "city_id", F.concat(F.col("city_id").cast("string"), F.lit("-"), "run_label").alias("scoring_run_id"), "hour_utc",
        noon.alias("scoring_run_timestamp"), (local + F.col("propagation_uplift")).alias("composite_risk"), "propagation_uplift",
        F.col("sub_lane").alias("sub_score_lane_marking"), F.col("sub_glare").alias("sub_score_glare"),
        F.col("sub_junction").alias("sub_score_junction_complexity"), F.col("sub_historical").alias("sub_score_historical"),
        "confidence", "is_stub_lane_marking", "inserted_at",
    )


def scoring_runs(spark: SparkSession, d: str) -> DataFrame:
    date = lambda x: F.lit(x).cast("date")
    runs = segment_scores(spark, d).groupBy("scoring_run_id", "city_id").agg(F.max("inserted_at").alias("scoring_run_timestamp"))
    return runs.select(
        "scoring_run_id", "city_id", "scoring_run_timestamp", F.lit("synthetic-0.1.0").alias("perception_model_version"), date("2025-06-01").alias("osm_snapshot_date"),
        date("2020-01-01").alias("imagery_window_start"), date("2024-01-02").alias("imagery_window_end_excl"), F.lit("pagerank-diffusion-0.1.0").alias("propagation_algorithm_version"),
    )
