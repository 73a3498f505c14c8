"""Queries on score history: lookups, comparisons, statistics, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import risk
from ..operators import delta, lookups, percentiles
from . import fixtures as X
from .registry import query


def r6(c, name: str | None = None):
    """Six decimals, without negative zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if isinstance(c, str) or name else out


RUN_A, RUN_B = "1-A", "1-B"
DELTA_SQL = """
  SELECT a.city_id, a.segment_id, a.hour_utc, b.composite_risk - a.composite_risk AS composite_delta,
    greatest(0e0, b.composite_risk - b.propagation_uplift) - greatest(0e0, a.composite_risk - a.propagation_uplift) AS local_delta,
    b.propagation_uplift - a.propagation_uplift AS uplift_delta,
    coalesce(b.sub_score_lane_marking, 0e0) - coalesce(a.sub_score_lane_marking, 0e0) AS lane_marking_delta,
    coalesce(b.sub_score_glare, 0e0) - coalesce(a.sub_score_glare, 0e0) AS glare_delta,
    coalesce(b.sub_score_junction_complexity, 0e0) - coalesce(a.sub_score_junction_complexity, 0e0) AS junction_complexity_delta,
    coalesce(b.sub_score_historical, 0e0) - coalesce(a.sub_score_historical, 0e0) AS historical_delta,
    a.confidence AS a_confidence, b.confidence AS b_confidence
  FROM v_segment_scores a JOIN v_segment_scores b ON a.segment_id = b.segment_id AND a.city_id = b.city_id AND a.hour_utc = b.hour_utc
  WHERE a.scoring_run_id = '1-A' AND b.scoring_run_id = '1-B' AND a.hour_utc = 12"""
PARTS = ("composite_delta", "local_delta", "uplift_delta", "lane_marking_delta", "glare_delta", "junction_complexity_delta", "historical_delta")
ROUNDED = ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in PARTS)


def changes(spark, d) -> DataFrame:
    return delta.deltas(delta.pair(X.segment_scores(spark, d), RUN_A, RUN_B, 12))


def rounded(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("city_id", "segment_id", "hour_utc", *(r6(c) for c in PARTS), "a_confidence", "b_confidence", *extra)


@query("l5_largest_changes", f"SELECT city_id, segment_id, hour_utc, {ROUNDED}, a_confidence, b_confidence, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY abs(composite_delta) DESC, segment_id) AS rank FROM ({DELTA_SQL}) q) z WHERE rank <= 100")
def l5(spark, d):
    return rounded(delta.largest(changes(spark, d), 100), "rank")


@query("s9_run_delta", f"SELECT city_id, segment_id, hour_utc, {ROUNDED}, a_confidence, b_confidence FROM ({DELTA_SQL}) q")
def s9(spark, d):
    return rounded(changes(spark, d))


@query("q7_delta_page", f"SELECT city_id, segment_id, hour_utc, {ROUNDED}, a_confidence, b_confidence FROM ({DELTA_SQL}) q ORDER BY segment_id LIMIT 100 OFFSET 100")
def q7(spark, d):
    return rounded(delta.compare(X.segment_scores(spark, d), X.scoring_runs(spark, d), RUN_A, RUN_B, 12, page=2, page_size=100))


@query("a1_pair_count", f"SELECT count(*) AS n FROM ({DELTA_SQL}) q")
def a1(spark, d):
    return changes(spark, d).agg(F.count("*").alias("n"))


@query("a17_delta_histogram", f"""
  SELECT CAST(b.bin AS INT) AS bin, round(-1e0 + b.bin * 0.1e0, 6) + 0e0 AS x0, round(-1e0 + (b.bin + 1) * 0.1e0, 6) + 0e0 AS x1, coalesce(c.n, 0) AS n, max(coalesce(c.n, 0)) OVER () AS max_n
  FROM range(20) AS b(bin) LEFT JOIN (
    SELECT CAST({' + '.join(f'CASE WHEN composite_delta >= -1e0 + {i + 1} * 0.1e0 THEN 1 ELSE 0 END' for i in range(19))} AS BIGINT) AS bin, count(*) AS n
    FROM ({DELTA_SQL}) q WHERE composite_delta BETWEEN -1e0 AND 1e0 GROUP BY 1) c ON b.bin = c.bin""")
def a17(spark, d):
    return delta.histogram(changes(spark, d)).select("bin", r6("x0"), r6("x1"), "n", "max_n")


@query("f31_delta_display", f"""
  SELECT segment_id, CASE WHEN abs(c) < 0.01e0 THEN 'neutral' WHEN c >= 0.15e0 THEN 'heavy_increase' WHEN c > 0 THEN 'increase' WHEN c <= -0.15e0 THEN 'heavy_decrease' ELSE 'decrease' END AS class,
    round(1.5e0 + greatest(0e0, least(1e0, abs(c) / 0.3e0)) * 6.5e0, 6) AS width, CASE WHEN printf('%+.3f', c) = '-0.000' THEN '+0.000' ELSE printf('%+.3f', c) END AS label
  FROM (SELECT segment_id, round(composite_delta, 6) + 0e0 AS c FROM ({DELTA_SQL}) q) z""")
def f31(spark, d):
    c = changes(spark, d).select("segment_id", r6("composite_delta", "c"))
    return c.select("segment_id", risk.delta_class(F.col("c")).alias("class"), r6(risk.delta_width(F.col("c")), "width"), risk.signed3(F.col("c")).alias("label"))


@query("s10_tile_delta", """
  SELECT s.segment_id, round(b.composite_risk - a.composite_risk, 6) + 0e0 AS composite_delta,
    round((b.composite_risk - b.propagation_uplift) - (a.composite_risk - a.propagation_uplift), 6) + 0e0 AS local_delta,
    round(b.sub_score_historical - a.sub_score_historical, 6) + 0e0 AS historical_delta
  FROM v_road_segments s JOIN v_segment_scores a ON a.segment_id = s.segment_id AND a.scoring_run_id = '1-A' AND a.hour_utc = 12
  JOIN v_segment_scores b ON b.segment_id = s.segment_id AND b.scoring_run_id = '1-B' AND b.hour_utc = 12 WHERE s.city_id = 1""")
def s10(spark, d):
    seg = X.road_segments(spark, d).where("city_id = 1").select("segment_id")
    p = delta.deltas(delta.pair(X.segment_scores(spark, d), RUN_A, RUN_B, 12), clamp_local=False, null_as_zero=False)
    return seg.join(p, "segment_id").select("segment_id", r6("composite_delta"), r6("local_delta"), r6("historical_delta"))


LATEST = "row_number() OVER (PARTITION BY segment_id ORDER BY inserted_at DESC, scoring_run_timestamp DESC, score_id DESC)"


@query("j1_latest_score", f"SELECT s.segment_id, s.city_id, c.score_id, round(c.composite_risk, 6) AS composite_risk FROM v_road_segments s LEFT JOIN (SELECT *, {LATEST} AS rn FROM v_segment_scores) c ON s.segment_id = c.segment_id AND c.rn = 1")
def j1(spark, d):
    out = lookups.with_latest(X.road_segments(spark, d).select("segment_id", "city_id"), X.segment_scores(spark, d).drop("city_id"))
    return out.select("segment_id", "city_id", "score_id", r6("composite_risk"))


@query("j2_nearest_in_time", """
  SELECT segment_id, score_id, round(composite_risk, 6) AS composite_risk FROM (
    SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY abs(epoch(scoring_run_timestamp) - epoch(TIMESTAMP '2025-06-21 08:20:00')), inserted_at DESC, scoring_run_timestamp DESC, score_id DESC) AS rn
    FROM v_segment_scores) q WHERE rn = 1""")
def j2(spark, d):
    return lookups.nearest_in_time(X.segment_scores(spark, d), F.lit("2025-06-21 08:20:00").cast("timestamp")).select("segment_id", "score_id", r6("composite_risk"))


@query("j3_snapped_hour", f"SELECT segment_id, score_id FROM (SELECT *, {LATEST} AS rn FROM v_segment_scores WHERE scoring_run_timestamp = TIMESTAMP '2025-06-21 12:00:00') q WHERE rn = 1")
def j3(spark, d):
    return lookups.snapped(X.segment_scores(spark, d), F.lit("2025-06-21 11:30:00").cast("timestamp")).select("segment_id", "score_id")


@query("j6_scores_with_runs", "SELECT s.score_id, s.scoring_run_id, r.perception_model_version, r.osm_snapshot_date FROM v_segment_scores s LEFT JOIN v_scoring_runs r ON s.scoring_run_id = r.scoring_run_id AND s.city_id = r.city_id")
def j6(spark, d):
    runs = X.scoring_runs(spark, d).select("scoring_run_id", "city_id", "perception_model_version", "osm_snapshot_date")
    return X.segment_scores(spark, d).join(runs, ["scoring_run_id", "city_id"], "left").select("score_id", "scoring_run_id", "perception_model_version", "osm_snapshot_date")


@query("j11_freshness", """
  SELECT c.city_id, c.slug, s.m AS scored_at, i.m AS incident_at, g.m AS imagery_at, r.m AS run_at FROM v_cities c
  LEFT JOIN (SELECT city_id, max(inserted_at) AS m FROM v_segment_scores GROUP BY 1) s ON s.city_id = c.city_id
  LEFT JOIN (SELECT city_id, max(incident_at) AS m FROM v_incidents GROUP BY 1) i ON i.city_id = c.city_id
  LEFT JOIN (SELECT city_id, max(capture_date) AS m FROM v_segment_imagery GROUP BY 1) g ON g.city_id = c.city_id
  LEFT JOIN (SELECT city_id, max(scoring_run_timestamp) AS m FROM v_scoring_runs GROUP BY 1) r ON r.city_id = c.city_id""")
def j11(spark, d):
    out = X.cities(spark, d).select("city_id", "slug")
    for df, col, name in ((X.segment_scores(spark, d), "inserted_at", "scored_at"), (X.incidents(spark, d), "incident_at", "incident_at"), (X.segment_imagery(spark, d), "capture_date", "imagery_at"), (X.scoring_runs(spark, d), "scoring_run_timestamp", "run_at")):
        out = out.join(df.groupBy("city_id").agg(F.max(col).alias(name)), "city_id", "left")
    return out


@query("j14_orphans", "SELECT count(*) AS n FROM v_road_segments s LEFT JOIN v_cities c ON s.city_id = c.city_id WHERE c.city_id IS NULL")
def j14(spark, d):
    return X.road_segments(spark, d).join(X.cities(spark, d), "city_id", "left_anti").agg(F.count("*").alias("n"))


@query("w1_run_scores_last_hour", """
  SELECT segment_id, score_id, hour_utc FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY scoring_run_timestamp DESC, inserted_at DESC, score_id DESC) AS rn
  FROM v_segment_scores WHERE scoring_run_id = '1-A' AND city_id = 1) q WHERE rn = 1""")
def w1(spark, d):
    return lookups.last_hour(X.segment_scores(spark, d).where("scoring_run_id = '1-A' AND city_id = 1")).select("segment_id", "score_id", "hour_utc")


@query("w5_hour_series", """
  SELECT segment_id, scoring_run_id, round(coalesce(max(CASE WHEN hour_utc = 0 THEN propagation_uplift END), 0e0), 6) AS h0, round(coalesce(max(CASE WHEN hour_utc = 6 THEN propagation_uplift END), 0e0), 6) AS h6,
    round(coalesce(max(CASE WHEN hour_utc = 12 THEN propagation_uplift END), 0e0), 6) AS h12, round(coalesce(max(CASE WHEN hour_utc = 18 THEN propagation_uplift END), 0e0), 6) AS h18, 24 AS n
  FROM v_segment_scores GROUP BY 1, 2""")
def w5(spark, d):
    m = X.segment_scores(spark, d).groupBy("segment_id", "scoring_run_id").agg(F.map_from_entries(F.collect_list(F.struct("hour_utc", "propagation_uplift"))).alias("m"))
    series = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.col("m")[h], F.lit(0.0)))
    return m.select("segment_id", "scoring_run_id", series.alias("s")).select("segment_id", "scoring_run_id", *(r6(F.col("s")[h], f"h{h}") for h in (0, 6, 12, 18)), F.size("s").alias("n"))


@query("l1_segment_list", f"SELECT s.segment_id, s.city_id, coalesce(round(c.composite_risk, 6), -1) AS composite_risk FROM v_road_segments s LEFT JOIN (SELECT *, {LATEST} AS rn FROM v_segment_scores) c ON s.segment_id = c.segment_id AND c.rn = 1 WHERE s.city_id = 1 ORDER BY s.segment_id LIMIT 50")
def l1(spark, d):
    page = X.road_segments(spark, d).where("city_id = 1").select("segment_id", "city_id").orderBy("segment_id").limit(50)
    scores = X.segment_scores(spark, d).drop("city_id").join(F.broadcast(page.select("segment_id")), "segment_id", "left_semi")  # 50 rows
    return page.join(lookups.latest(scores), "segment_id", "left").select("segment_id", "city_id", F.coalesce(r6(F.col("composite_risk")), F.lit(-1.0)).alias("composite_risk"))


@query("l3_runs_newest_first", "SELECT scoring_run_id, city_id, scoring_run_timestamp FROM v_scoring_runs WHERE city_id = 1 ORDER BY scoring_run_timestamp DESC, scoring_run_id")
def l3(spark, d):
    return X.scoring_runs(spark, d).where("city_id = 1").select("scoring_run_id", "city_id", "scoring_run_timestamp").orderBy(F.desc("scoring_run_timestamp"), "scoring_run_id")


@query("q1_cities_by_slug", "SELECT city_id, slug, name, round(min_lon, 6) AS min_lon, round(max_lat, 6) AS max_lat, default_zoom, timezone FROM v_cities ORDER BY slug")
def q1(spark, d):
    return X.cities(spark, d).select("city_id", "slug", "name", r6("min_lon"), r6("max_lat"), "default_zoom", "timezone").orderBy("slug")


@query("snk8_etag", """
  SELECT city_id, j AS json, concat('"', substring(sha256(j), 1, 16), '"') AS etag FROM (
    SELECT city_id, concat('{"default_zoom":', CAST(default_zoom AS VARCHAR), ',"name":"', name, '","slug":"', slug, '","timezone":"', timezone, '"}') AS j FROM v_cities) q""")
def snk8(spark, d):
    j = F.to_json(F.struct("default_zoom", "name", "slug", "timezone"))
    return X.cities(spark, d).select("city_id", j.alias("json"), F.concat(F.lit('"'), F.substring(F.sha2(j, 256), 1, 16), F.lit('"')).alias("etag"))


@query("q5_run_guard", "SELECT scoring_run_id, city_id FROM v_scoring_runs WHERE scoring_run_id = '1-A' AND city_id = 2")
def q5(spark, d):
    return X.scoring_runs(spark, d).where("scoring_run_id = '1-A' AND city_id = 2").select("scoring_run_id", "city_id")


@query("pf2_unknown_slug", "SELECT s.segment_id FROM v_road_segments s JOIN v_cities c ON s.city_id = c.city_id WHERE c.slug = 'nowhere'")
def pf2(spark, d):
    return X.road_segments(spark, d).join(F.broadcast(X.cities(spark, d).where("slug = 'nowhere'").select("city_id")), "city_id").select("segment_id")  # one city at most


@query("pf7_hour_of_day", "SELECT score_id, segment_id FROM v_segment_scores WHERE city_id = 2 AND extract(hour FROM scoring_run_timestamp) = 6")
def pf7(spark, d):
    return X.segment_scores(spark, d).where((F.col("city_id") == 2) & (F.hour("scoring_run_timestamp") == 6)).select("score_id", "segment_id")


@query("pf9_null_rule", "SELECT score_id, coalesce(round(sub_score_historical, 6), 0e0) AS historical, coalesce(is_stub_lane_marking, false) AS is_stub, round(greatest(0e0, composite_risk - propagation_uplift), 6) AS local FROM v_segment_scores")
def pf9(spark, d):
    s = X.segment_scores(spark, d)
    return s.select("score_id", F.coalesce(r6(F.col("sub_score_historical")), F.lit(0.0)).alias("historical"), F.coalesce("is_stub_lane_marking", F.lit(False)).alias("is_stub"), r6(F.greatest(F.lit(0.0), F.col("composite_risk") - F.col("propagation_uplift")), "local"))


@query("pf11_version_split", """
  SELECT v, CASE WHEN v = 'none-phase-2' THEN NULL WHEN strpos(v, '-') = 0 THEN v ELSE regexp_extract(v, '^(.*)-([^-]*)$', 1) END AS name,
    CASE WHEN v = 'none-phase-2' THEN NULL WHEN strpos(v, '-') = 0 THEN '' ELSE regexp_extract(v, '^(.*)-([^-]*)$', 2) END AS version
  FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'none-phase-2' WHEN 1 THEN concat('pagerank-diffusion-0.', CAST(p_size AS VARCHAR)) WHEN 2 THEN concat('garbled', CAST(p_size AS VARCHAR)) ELSE concat('x-', CAST(p_size AS VARCHAR), '-') END AS v FROM part) q""")
def pf11(spark, d):
    k, t = F.col("p_size"), F.col("p_size").cast("string")
    v = F.when(k % 4 == 0, "none-phase-2").when(k % 4 == 1, F.concat(F.lit("pagerank-diffusion-0."), t)).when(k % 4 == 2, F.concat(F.lit("garbled"), t)).otherwise(F.concat(F.lit("x-"), t, F.lit("-")))
    return X.table(spark, d, "part").select(v.alias("v")).distinct().select("v", risk.version_name(F.col("v")).alias("name"), risk.version_number(F.col("v")).alias("version"))


@query("pf12_stub_count", "SELECT scoring_run_id, count(*) FILTER (WHERE is_stub_lane_marking) AS stubs, count(*) AS n FROM v_segment_scores GROUP BY 1")
def pf12(spark, d):
    return X.segment_scores(spark, d).groupBy("scoring_run_id").agg(F.count_if("is_stub_lane_marking").alias("stubs"), F.count("*").alias("n"))


@query("pf13_run_exists", "SELECT r.scoring_run_id FROM v_scoring_runs r WHERE EXISTS (SELECT 1 FROM v_segment_scores s WHERE s.scoring_run_id = r.scoring_run_id AND s.hour_utc = 18)")
def pf13(spark, d):
    return X.scoring_runs(spark, d).join(X.segment_scores(spark, d).where("hour_utc = 18"), "scoring_run_id", "left_semi").select("scoring_run_id")


@query("a14_run_summary", "SELECT scoring_run_id, count(*) AS n_rows, count(DISTINCT segment_id) AS segments, count(DISTINCT hour_utc) AS samples FROM v_segment_scores GROUP BY 1")
def a14(spark, d):
    return X.segment_scores(spark, d).groupBy("scoring_run_id").agg(F.count("*").alias("n_rows"), F.countDistinct("segment_id").alias("segments"), F.countDistinct("hour_utc").alias("samples"))


@query("a15_pearson", "SELECT city_id, round(coalesce(corr(sub_score_glare, composite_risk), 0e0), 6) AS r FROM v_segment_scores GROUP BY 1")
def a15(spark, d):
    return X.segment_scores(spark, d).groupBy("city_id").agg(r6(F.coalesce(F.corr("sub_score_glare", "composite_risk"), F.lit(0.0)), "r"))


@query("a16_percentiles", """
  SELECT city_id, round(median(composite_risk), 6) AS p50, round(max(CASE WHEN k = ceil(0.95e0 * n) THEN composite_risk END), 6) AS p95, round(max(CASE WHEN k = ceil(0.99e0 * n) THEN composite_risk END), 6) AS p99,
    round(avg(composite_risk), 6) AS mean, round(max(composite_risk), 6) AS most
  FROM (SELECT city_id, composite_risk, row_number() OVER (PARTITION BY city_id ORDER BY composite_risk) AS k, count(*) OVER (PARTITION BY city_id) AS n FROM v_segment_scores) q GROUP BY 1""")
def a16(spark, d):
    """Nearest-rank p95 and p99; p50 interpolates. Ranks are found by refined histograms; no task holds a city's values."""
    values = X.segment_scores(spark, d).select("city_id", F.col("composite_risk").alias("x"))
    out = percentiles.summary(values, ["city_id"], {"p95": 0.95, "p99": 0.99})
    return out.select("city_id", *(r6(c) for c in ("p50", "p95", "p99", "mean", "most")))


@query("a13_mean_of_real", """
  SELECT score_id, round(CASE WHEN is_stub_lane_marking THEN (sub_score_glare + sub_score_junction_complexity) / 2 ELSE (sub_score_lane_marking + sub_score_glare + sub_score_junction_complexity) / 3 END, 6) AS composite,
    round(CASE WHEN is_stub_lane_marking THEN 1e0 ELSE least(confidence, 1e0) END, 6) AS confidence FROM v_segment_scores""")
def a13(spark, d):
    """The provisional composite: the mean of the sub-scores that are no stubs, and their smallest confidence."""
    one = lambda v, c, stub: F.struct(v.alias("value"), c.alias("confidence"), stub.alias("stub"))
    subs = F.array(one(F.col("sub_score_lane_marking"), F.col("confidence"), F.col("is_stub_lane_marking")), one(F.col("sub_score_glare"), F.lit(1.0), F.lit(False)), one(F.col("sub_score_junction_complexity"), F.lit(1.0), F.lit(False)))
    s = X.segment_scores(spark, d).select("score_id", F.filter(subs, lambda x: ~x["stub"]).alias("real"))
    mean = F.aggregate("real", F.lit(0.0), lambda a, x: a + x["value"]) / F.size("real")
    return s.select("score_id", r6(F.coalesce(mean, F.lit(0.0)), "composite"), r6(F.coalesce(F.array_min(F.transform("real", lambda x: x["confidence"])), F.lit(0.0)), "confidence"))


@query("s5_local_aggregate", "SELECT score_id, round(0.35e0 * sub_score_glare + 0.30e0 * sub_score_lane_marking + 0.20e0 * sub_score_junction_complexity + 0.15e0 * coalesce(sub_score_historical, 0e0), 6) AS local, round(composite_risk, 6) AS composite FROM v_segment_scores")
def s5(spark, d):
    local = risk.local_aggregate(F.col("sub_score_glare"), F.col("sub_score_lane_marking"), F.col("sub_score_junction_complexity"), F.col("sub_score_historical"))
    return X.segment_scores(spark, d).select("score_id", r6(local, "local"), r6(local + F.col("propagation_uplift"), "composite"))


@query("f30_colour_bucket", "SELECT score_id, CAST(CASE WHEN is_stub_lane_marking OR sub_score_lane_marking IS NULL THEN -1 ELSE least(floor(sub_score_lane_marking * 5), 4) END AS INT) AS bucket FROM v_segment_scores")
def f30(spark, d):
    return X.segment_scores(spark, d).select("score_id", risk.colour_bucket(F.col("sub_score_lane_marking"), F.col("is_stub_lane_marking")).alias("bucket"))


@query("l7_hashed_sample", "SELECT segment_id FROM v_road_segments ORDER BY sha256(CAST(segment_id AS VARCHAR)), segment_id LIMIT 100")
def l7(spark, d):
    """A repeatable sample: the 100 segments of smallest digest."""
    return X.road_segments(spark, d).select("segment_id").orderBy(F.sha2(F.col("segment_id").cast("string"), 256), "segment_id").limit(100)


@query("f28_stub_hash")
def f28(spark, d):
    u = risk.stub_hash(F.col("segment_id").cast("string"), "composite")
    return X.road_segments(spark, d).select("segment_id", u.alias("u"), risk.stub_bucket(u).alias("bucket"))


@query("a22_winner", """
  WITH c AS (SELECT scoring_run_id AS id, avg(confidence) AS quality, avg(composite_risk) AS cost FROM v_segment_scores GROUP BY 1),
  ok AS (SELECT *, max(quality) OVER () AS best FROM c WHERE quality >= 0.4e0 AND cost <= 5e0)
  SELECT id, round(quality, 6) AS quality FROM ok WHERE quality >= best - 0.02e0 ORDER BY cost, id LIMIT 1""")
def a22(spark, d):
    """Best quality among candidates above a floor and within a budget; within 0.02 of the best the cheapest wins."""
    c = X.segment_scores(spark, d).groupBy(F.col("scoring_run_id").alias("id")).agg(F.avg("confidence").alias("quality"), F.avg("composite_risk").alias("cost"))
    ok = c.where("quality >= 0.4 AND cost <= 5")
    return ok.crossJoin(F.broadcast(ok.agg(F.max("quality").alias("best")))).where("quality >= best - 0.02").orderBy("cost", "id").limit(1).select("id", r6("quality"))


@query("w4_rank_within_city", "SELECT city_id, segment_id, score_id, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY abs(composite_risk) DESC, score_id) AS rk FROM v_segment_scores) q WHERE rk <= 20")
def w4(spark, d):
    w = Window.partitionBy("city_id").orderBy(F.desc(F.abs("composite_risk")), "score_id")
    return X.segment_scores(spark, d).withColumn("rk", F.row_number().over(w)).where("rk <= 20").select("city_id", "segment_id", "score_id", "rk")
