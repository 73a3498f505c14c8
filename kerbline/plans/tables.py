"""Queries on table maintenance: upserts, insert-ignore, classification, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk
from ..operators import merge
from ..sources import incidents as pages
from . import fixtures as X
from .core import r6
from .registry import query


@query("snk1_upsert_segments", """
  SELECT osm_way_id, city_id, highway FROM v_road_segments WHERE osm_way_id % 10 <> 0 UNION ALL SELECT osm_way_id, 4 - city_id, 'service' FROM v_road_segments WHERE osm_way_id % 10 = 0
  UNION ALL SELECT osm_way_id + 100000000, city_id, highway FROM v_road_segments WHERE osm_way_id % 50 = 1""")
def snk1(spark, d):
    s = X.road_segments(spark, d).select("osm_way_id", "city_id", "highway")
    again = s.where("osm_way_id % 10 = 0")
    new = again.withColumn("seq", F.lit(1)).unionByName(again.select("osm_way_id", (4 - F.col("city_id")).alias("city_id"), F.lit("service").alias("highway"), F.lit(2).alias("seq")))
    new = new.unionByName(s.where("osm_way_id % 50 = 1").select((F.col("osm_way_id") + 100000000).alias("osm_way_id"), "city_id", "highway", F.lit(1).alias("seq")))
    return merge.upsert(s.withColumn("seq", F.lit(0)), new, ["osm_way_id"], "seq").select("osm_way_id", "city_id", "highway")


@query("snk2_insert_ignore", "SELECT provider, provider_incident_id, severity FROM v_incidents WHERE CAST(provider_incident_id AS BIGINT) % 3 = 0")
def snk2(spark, d):
    i = X.incidents(spark, d).select("provider", "provider_incident_id", "severity", "incident_at")
    n = F.col("provider_incident_id").cast("long")
    return merge.insert_ignore(i.where(n % 3 != 0), i.unionByName(i), ("provider", "provider_incident_id"), "incident_at").select("provider", "provider_incident_id", "severity")


@query("j10_skip_existing", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = e.event_id AND o.o_custkey % 2 = 0)")
def j10(spark, d):
    old = X.table(spark, d, "orders").where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("event_id"))
    return merge.skip_existing(old, X.table(spark, d, "events").select("event_id"), ["event_id"])


@query("snk3_imagery_insert_ignore", "SELECT provider, provider_image_id, segment_id FROM v_segment_imagery WHERE CAST(provider_image_id AS BIGINT) % 4 = 1")
def snk3(spark, d):
    i = X.segment_imagery(spark, d).select("provider", "provider_image_id", "segment_id", "sample_index")
    n = F.col("provider_image_id").cast("long")
    return merge.insert_ignore(i.where(n % 4 != 1), i, ("provider", "provider_image_id", "segment_id"), "sample_index").select("provider", "provider_image_id", "segment_id")


@query("snk4_classify_cities", """
  SELECT slug, CASE WHEN city_id = 0 THEN 'inserted' WHEN city_id = 1 THEN 'absent' WHEN city_id = 2 THEN 'updated' ELSE 'unchanged' END AS status FROM v_cities""")
def snk4(spark, d):
    c = X.cities(spark, d)
    old = c.where("city_id <> 0").withColumn("default_zoom", F.when(F.col("city_id") == 2, 11).otherwise(F.col("default_zoom")))
    return merge.classify(old, c.where("city_id <> 1"), "slug", ("name", "default_zoom", "timezone"))


@query("snk6_freshness_bump", """
  SELECT k.name, coalesce(m.at, TIMESTAMP '2020-01-01 00:00:00') AS last_ingested_at FROM (VALUES ('fatal'), ('injury'), ('imagery')) AS k(name) LEFT JOIN (SELECT severity, max(incident_at) AS at FROM v_incidents GROUP BY 1) m ON m.severity = k.name""")
def snk6(spark, d):
    names = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("fatal", "injury", "imagery")))).alias("name"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("last_ingested_at"))
    return merge.bump_freshness(names, X.incidents(spark, d).select(F.col("severity").alias("name"), "incident_at"), "incident_at")


@query("f10_severity_mapping", """
  SELECT p_partkey, CASE trim(t) WHEN 'Fatal injury' THEN 'fatal' WHEN 'Non-fatal injury' THEN 'injury' WHEN 'Non-fatal injury - Possible injury' THEN 'injury' WHEN 'Property damage only (none injured)' THEN 'property_damage_only' ELSE 'unknown' END AS severity
  FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Fatal injury' WHEN 1 THEN 'Non-fatal injury ' WHEN 2 THEN 'Non-fatal injury - Possible injury' WHEN 3 THEN 'Property damage only (none injured)' WHEN 4 THEN 'something else' END AS t FROM part) q""")
def f10(spark, d):
    k = F.col("p_partkey") % 6
    t = F.when(k == 0, " Fatal injury").when(k == 1, "Non-fatal injury ").when(k == 2, "Non-fatal injury - Possible injury").when(k == 3, "Property damage only (none injured)").when(k == 4, "something else")
    return X.table(spark, d, "part").select("p_partkey", risk.raw_severity(t).alias("severity"))


@query("f8_incident_weight", """
  SELECT event_id, round(exp(-power(user_id % 60, 2) / 1250e0) * power(0.5e0, greatest(CAST(user_id % 900 - 100 AS DOUBLE), 0e0) / 365e0) * CASE event_type WHEN 'error' THEN 3e0 WHEN 'purchase' THEN 2e0 ELSE 1e0 END, 6) AS weight FROM events""")
def f8(spark, d):
    kind = risk.lookup({"error": "fatal", "purchase": "injury"}, F.col("event_type"), "unknown")
    w = risk.incident_weight((F.col("user_id") % 60).cast("double"), (F.col("user_id") % 900 - 100).cast("double"), kind)
    return X.table(spark, d, "events").select("event_id", r6(w, "weight"))


@query("f25_epoch_millis", "SELECT event_id, CAST(epoch_ms(CAST(1600000000000 + event_id * 86400000 AS BIGINT)) AS DATE) AS day FROM events")
def f25(spark, d):
    return X.table(spark, d, "events").select("event_id", risk.epoch_day(F.lit(1600000000000) + F.col("event_id") * 86400000).alias("day"))


@query("f24_daterange", "SELECT city_id, min(capture_date) AS start_date, max(capture_date) + 1 AS end_excl FROM v_segment_imagery GROUP BY 1")
def f24(spark, d):
    return X.segment_imagery(spark, d).groupBy("city_id").agg(risk.day_range(F.min("capture_date"), F.max("capture_date")).alias("r")).select("city_id", F.col("r.start").alias("start_date"), "r.end_excl")


@query("f38_backoff_and_widths", "SELECT p_size, least(2e0 * power(2e0, p_size - 1), 300e0) AS backoff, round(greatest(0e0, least(100e0, p_size * 2.5e0)), 6) AS width FROM (SELECT DISTINCT p_size FROM part) q")
def f38(spark, d):
    p = X.table(spark, d, "part").select("p_size").distinct()
    return p.select("p_size", risk.backoff(F.col("p_size")).alias("backoff"), r6(risk.bar_width(F.col("p_size"), 2.5), "width"))


@query("src4_year_pruning", "SELECT CAST(extract(year FROM ts) AS INT) AS year, count(*) AS n FROM events WHERE extract(year FROM ts) BETWEEN 2024 AND 2025 GROUP BY 1")
def src4(spark, d):
    """Years are pruned by a range of the time, which reaches the scan."""
    e = pages.in_years(X.table(spark, d, "events"), 2024, 2025, "ts")
    return e.groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"))


@query("src10_incident_scan", "SELECT provider_incident_id, round(lat, 6) AS lat, round(lon, 6) AS lon, incident_at, severity FROM v_incidents WHERE city_id = 2")
def src10(spark, d):
    return X.incidents(spark, d).where("city_id = 2").select("provider_incident_id", r6("lat"), r6("lon"), "incident_at", "severity")
