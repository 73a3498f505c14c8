"""Queries on the road network: geometry, topology, incidents, perception, sun, propagation, composite, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, risk, solar
from .. import table_functions
from ..operators import detail, graph, historical, lookups, merge, perception, scoring, topology, vector_tiles
from . import fixtures as X
from .core import LATEST, r6
from .registry import query

BEARING = "(degrees(atan2(sin(radians(x2 - x1)) * cos(radians(y2)), cos(radians(y1)) * sin(radians(y2)) - sin(radians(y1)) * cos(radians(y2)) * cos(radians(x2 - x1)))) + 360e0) % 360e0"


def azimuth_sql(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"CASE WHEN {x2} = {x1} AND {y2} = {y1} THEN 0e0 ELSE (degrees(atan2({x2} - {x1}, {y2} - {y1})) + 360e0) % 360e0 END"


def circular(c, name: str, turn: float = 360.0):
    """Six decimals of an angle; a full turn is 0."""
    v = F.round(c, 6)
    return F.when(v >= turn, 0.0).otherwise(v + F.lit(0.0)).alias(name)


def circular_sql(e: str, turn: float = 360.0) -> str:
    return f"CASE WHEN round({e}, 6) >= {turn}e0 THEN 0e0 ELSE round({e}, 6) + 0e0 END"


@query("src8_scoring_segments", f"""
  SELECT segment_id, city_id, round(start_lon, 6) AS start_lon, round(end_lat, 6) AS end_lat, round(mid_lon, 6) AS lon, round(mid_lat, 6) AS lat, {circular_sql(BEARING)} AS bearing FROM (
    SELECT *, start_lon AS x1, start_lat AS y1, end_lon AS x2, end_lat AS y2 FROM v_road_segments) z""")
def src8(spark, d):
    """Lines of 2 to 200 vertices: ends, centroid weighted by the length of legs, bearing from end to end."""
    s = topology.scoring_view(X.road_segments(spark, d).select("segment_id", "city_id", "coords"))
    return s.select("segment_id", "city_id", r6("start_lon"), r6("end_lat"), r6(F.col("mid_lon"), "lon"), r6(F.col("mid_lat"), "lat"), circular(F.col("bearing"), "bearing"))


LON, LAT = "list_transform(coords, lambda c: c.lon)", "list_transform(coords, lambda c: c.lat)"
WEST, EAST, SOUTH, NORTH = f"list_min({LON})", f"list_max({LON})", f"list_min({LAT})", f"list_max({LAT})"
FIRST_LEG, LAST_LEG = ("coords[1].lon", "coords[1].lat", "coords[2].lon", "coords[2].lat"), ("coords[-2].lon", "coords[-2].lat", "coords[-1].lon", "coords[-1].lat")


@query("geo_wkb", """
  SELECT segment_id, lower(hex(CAST(CAST(CAST(0 AS UTINYINT) AS BIT) AS BLOB))) || lower(hex(CAST(CAST(CAST(2 AS INTEGER) AS BIT) AS BLOB))) || lower(hex(CAST(CAST(CAST(len(coords) AS INTEGER) AS BIT) AS BLOB)))
      || list_aggregate(list_transform(coords, lambda c: lower(hex(CAST(CAST(c.lon AS BIT) AS BLOB))) || lower(hex(CAST(CAST(c.lat AS BIT) AS BLOB)))), 'string_agg', '') AS wkb,
    len(coords) AS vertices, true AS same FROM v_road_segments""")
def geo_wkb(spark, d):
    """Lines to WKB and back."""
    s = X.road_segments(spark, d).select("segment_id", "coords", geo.to_wkb("coords").alias("wkb"))
    back = s.withColumn("back", geo.from_wkb("wkb"))
    return back.select("segment_id", F.lower(F.hex("wkb")).alias("wkb"), F.size("back").cast("long").alias("vertices"), (F.col("back") == F.col("coords")).alias("same"))


@query("geo_line_measures", f"""
  SELECT segment_id, round(length, 9) AS length, round({WEST}, 6) AS min_lon, round({SOUTH}, 6) AS min_lat, round({EAST}, 6) AS max_lon, round({NORTH}, 6) AS max_lat FROM (
    SELECT *, list_sum(list_transform(range(1, len(coords)), lambda i: sqrt(power(coords[i + 1].lon - coords[i].lon, 2) + power(coords[i + 1].lat - coords[i].lat, 2)))) AS length FROM v_road_segments) q""")
def geo_line_measures(spark, d):
    """Planar length and box of every line."""
    box = geo.bounds(F.col("coords"))
    return X.road_segments(spark, d).select("segment_id", F.round(geo.line_length(F.col("coords")), 9).alias("length"), *(r6(c, n) for n, c in box.items()))


TOPO = f"""SELECT segment_id, city_id, coalesce(try_cast(nullif(lanes, '') AS INT), 2) AS lanes, coalesce(nullif(highway, ''), 'unclassified') AS road_class,
    CAST(round(start_lon / 1e-6) AS BIGINT) AS sx, CAST(round(start_lat / 1e-6) AS BIGINT) AS sy, CAST(round(end_lon / 1e-6) AS BIGINT) AS ex, CAST(round(end_lat / 1e-6) AS BIGINT) AS ey,
    {azimuth_sql(*FIRST_LEG)} AS start_bearing, {azimuth_sql(*LAST_LEG)} AS end_bearing FROM v_road_segments"""
ENDS = f"""SELECT city_id, segment_id, lanes, road_class, 'start' AS side, sx AS x, sy AS y, start_bearing AS bearing FROM ({TOPO}) t0
    UNION ALL SELECT city_id, segment_id, lanes, road_class, 'end', ex, ey, end_bearing FROM ({TOPO}) t1"""


@query("src9_topology_scan", f"SELECT segment_id, lanes, road_class, sx, sy, ex, ey, {circular_sql('start_bearing')} AS start_bearing, {circular_sql('end_bearing')} AS end_bearing FROM ({TOPO}) t")
def src9(spark, d):
    t = topology.topology(X.road_segments(spark, d))
    return t.select("segment_id", "lanes", "road_class", "sx", "sy", "ex", "ey", circular(F.col("start_bearing"), "start_bearing"), circular(F.col("end_bearing"), "end_bearing"))


ADJ = f"SELECT DISTINCT a.city_id, a.segment_id AS src, b.segment_id AS dst FROM ({ENDS}) a JOIN ({ENDS}) b ON a.city_id = b.city_id AND a.x = b.x AND a.y = b.y AND a.segment_id <> b.segment_id"


@query("j7_adjacency", f"SELECT city_id, src, dst, 1e0 AS weight FROM ({ADJ}) q")
def j7(spark, d):
    return topology.adjacency(topology.topology(X.road_segments(spark, d)))


RANKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in risk.CLASS_RANK.items())
DIFF = "abs(a.bearing - b.bearing) % 360e0"
JUNC = f"""SELECT a.city_id, a.segment_id, a.side, count(*) AS legs,
    least(90e0, coalesce(min(CASE WHEN a.segment_id <> b.segment_id THEN greatest(least({DIFF}, 360e0 - {DIFF}), 1e0) END), 90e0)) AS angle,
    coalesce(max(CASE WHEN a.segment_id <> b.segment_id THEN abs(a.lanes - b.lanes) END), 0) AS lane_delta,
    coalesce(max(CASE WHEN a.segment_id <> b.segment_id THEN abs(a.rnk - b.rnk) END), 0) AS rank_delta
  FROM (SELECT *, CASE road_class {RANKS} ELSE 2 END AS rnk FROM ({ENDS}) e0) a JOIN (SELECT *, CASE road_class {RANKS} ELSE 2 END AS rnk FROM ({ENDS}) e1) b ON a.city_id = b.city_id AND a.x = b.x AND a.y = b.y
  GROUP BY 1, 2, 3"""


@query("j8_junction_legs", f"SELECT city_id, segment_id, side, legs, round(angle, 6) AS angle, lane_delta, rank_delta FROM ({JUNC}) j")
def j8(spark, d):
    return topology.junctions(topology.topology(X.road_segments(spark, d))).select("city_id", "segment_id", "side", "legs", r6("angle"), "lane_delta", "rank_delta")


S3 = f"""SELECT city_id, segment_id, legs, lane_delta, rank_delta, greatest(0e0, least(1e0,
    0.3e0 * CASE WHEN legs <= 1 THEN 0e0 ELSE greatest(0e0, least(1e0, (legs - 2) / 3e0)) END + 0.3e0 * greatest(0e0, least(1e0, (90e0 - angle) / 90e0)) + 0.2e0 * least(1e0, lane_delta / 3e0) + 0.2e0 * least(1e0, rank_delta / 3e0))) AS score
  FROM (SELECT city_id, segment_id, max(legs) AS legs, min(angle) AS angle, max(lane_delta) AS lane_delta, max(rank_delta) AS rank_delta FROM ({JUNC}) j GROUP BY 1, 2) q"""


@query("s3_junction_complexity", f"SELECT city_id, segment_id, legs, round(score, 6) AS score FROM ({S3}) s")
def s3(spark, d):
    return topology.junction_scores(topology.topology(X.road_segments(spark, d))).select("city_id", "segment_id", "legs", r6("score"))


def haversine_sql(a: str = "s.mid", b: str = "i.") -> str:
    h = f"power(sin(radians({b}lat - {a}_lat) / 2), 2) + cos(radians({a}_lat)) * cos(radians({b}lat)) * power(sin(radians({b}lon - {a}_lon) / 2), 2)"
    return f"12742000e0 * asin(least(1e0, sqrt({h})))"


NEAR = f"SELECT s.segment_id, s.city_id, i.provider_incident_id, i.severity, i.incident_at, {haversine_sql()} AS distance_m FROM v_road_segments s JOIN v_incidents i ON s.city_id = i.city_id AND {haversine_sql()} <= 50e0"


@query("j9_incident_distance_join", f"SELECT segment_id, count(*) AS n, round(min(distance_m), 3) AS nearest FROM ({NEAR}) q GROUP BY 1")
def j9(spark, d):
    return historical.near(X.road_segments(spark, d), X.incidents(spark, d)).groupBy("segment_id").agg(F.count("*").alias("n"), F.round(F.min("distance_m"), 3).alias("nearest"))


AT = "2025-06-21 12:00:00"
RAW = f"""SELECT s.city_id, s.segment_id, count(q.w) AS incidents, coalesce(sum(q.w), 0e0) AS raw FROM v_road_segments s LEFT JOIN (
    SELECT segment_id, exp(-power(distance_m, 2) / 1250e0) * power(0.5e0, greatest((epoch(TIMESTAMP '{AT}') - floor(epoch(incident_at))) / 86400e0, 0e0) / 365e0) * CASE severity WHEN 'fatal' THEN 3e0 WHEN 'injury' THEN 2e0 ELSE 1e0 END AS w
    FROM ({NEAR}) n) q ON s.segment_id = q.segment_id GROUP BY 1, 2"""


@query("s4_historical", f"SELECT city_id, segment_id, incidents, round(raw, 6) AS raw, round(least(1e0, raw), 6) AS score FROM ({RAW}) q")
def s4(spark, d):
    out = historical.scores(X.road_segments(spark, d), X.incidents(spark, d), F.lit(AT).cast("timestamp"))
    return out.select("city_id", "segment_id", "incidents", r6("raw"), r6("score"))


@query("a10_historical_normalised", f"SELECT city_id, segment_id, round(CASE WHEN max(raw) OVER (PARTITION BY city_id) > 0 THEN least(1e0, raw / max(raw) OVER (PARTITION BY city_id)) ELSE 0e0 END, 6) AS score FROM ({RAW}) q")
def a10(spark, d):
    return historical.scores(X.road_segments(spark, d), X.incidents(spark, d), F.lit(AT).cast("timestamp"), normalise=True).select("city_id", "segment_id", r6("score"))


IMG = """SELECT segment_id, sample_index, list_avg(p) AS value, least(1e0, 2 * sqrt(greatest(list_avg(list_transform(p, lambda x: x * x)) - power(list_avg(p), 2), 0e0))) AS uncertainty
  FROM (SELECT segment_id, sample_index, list_transform(logits, lambda x: 1e0 / (1e0 + exp(-CAST(x AS DOUBLE)))) AS p FROM v_segment_imagery) q"""


@query("a8_image_scores", f"SELECT segment_id, sample_index, round(value, 6) AS value, round(uncertainty, 6) AS uncertainty FROM ({IMG}) q")
def a8(spark, d):
    return perception.per_image(X.segment_imagery(spark, d)).select("segment_id", "sample_index", r6("value"), r6("uncertainty"))


@query("s2_lane_marking", f"""
  SELECT s.segment_id, count(q.value) AS images, round(coalesce(avg(q.value), 0e0), 6) AS value, round(CASE WHEN count(q.value) = 0 THEN 0e0 ELSE 1e0 - max(q.uncertainty) END, 6) AS confidence, count(q.value) = 0 AS is_stub
  FROM v_road_segments s LEFT JOIN ({IMG}) q ON s.segment_id = q.segment_id GROUP BY 1""")
def s2(spark, d):
    return perception.per_segment(X.road_segments(spark, d), X.segment_imagery(spark, d)).select("segment_id", "images", r6("value"), r6("confidence"), "is_stub")


@query("j12_imagery_by_segment", """
  SELECT segment_id, count(*) AS n, string_agg(concat(CAST(sample_index AS VARCHAR), ':', provider_image_id), ',' ORDER BY sample_index, provider_image_id) AS images FROM v_segment_imagery GROUP BY 1""")
def j12(spark, d):
    i = perception.index(X.segment_imagery(spark, d))
    return i.select("segment_id", F.size("images").cast("long").alias("n"), F.array_join(F.transform("images", lambda x: F.concat(x["sample_index"].cast("string"), F.lit(":"), x["provider_image_id"])), ",").alias("images"))


@query("a2_capture_window", "SELECT city_id, min(capture_date) AS first_date, max(capture_date) AS last_date FROM v_segment_imagery GROUP BY 1")
def a2(spark, d):
    return X.segment_imagery(spark, d).groupBy("city_id").agg(F.min("capture_date").alias("first_date"), F.max("capture_date").alias("last_date"))


@query("a5_severity_counts", """
  SELECT k.severity, count(i.severity) AS n FROM (VALUES ('fatal'), ('injury'), ('property_damage_only'), ('unknown'), ('reported')) AS k(severity) LEFT JOIN v_incidents i ON i.severity = k.severity GROUP BY 1""")
def a5(spark, d):
    """Counts by severity, buckets without incidents included."""
    kinds = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in (*risk.SEVERITIES, "reported")))).alias("severity"))
    n = X.incidents(spark, d).groupBy("severity").agg(F.count("*").alias("c"))
    return kinds.join(n, "severity", "left").select("severity", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


@query("a6_ingest_summary", """
  SELECT count(*) AS seen, count(*) FILTER (WHERE e.user_id % 3 = 0) AS skipped, count(*) FILTER (WHERE e.user_id % 3 <> 0) AS inserted, min(e.ts) AS first_at, max(e.ts) AS last_at FROM events e""")
def a6(spark, d):
    """A third of the events is there already."""
    e = X.table(spark, d, "events")
    return merge.ingest_summary(e.where("user_id % 3 = 0").select("event_id"), e, ["event_id"], "ts")


@query("pf8_date_window", "SELECT provider_incident_id FROM v_incidents WHERE CAST(incident_at AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) FROM events) AND (SELECT CAST(min(ts) AS DATE) + 9 FROM events)")
def pf8(spark, d):
    first = X.table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("first"))
    return X.incidents(spark, d).join(F.broadcast(first), F.to_date("incident_at").between(F.col("first"), F.date_add("first", 9))).select("provider_incident_id")  # one row


@query("src2_bbox_clip", "SELECT segment_id FROM v_road_segments WHERE len(list_filter(coords, lambda c: c.lon BETWEEN -70.66e0 AND -70.64e0 AND c.lat BETWEEN 42.35e0 AND 42.36e0)) > 0")
def src2(spark, d):
    return X.road_segments(spark, d).where(geo.bbox_hit(F.col("coords"), -70.66, 42.35, -70.64, 42.36)).select("segment_id")


_BOX = geo.tile_box(13, 2488, 3030)


@query("pf4_tile_bbox", f"SELECT segment_id FROM v_road_segments WHERE {EAST} >= {_BOX[0]!r} AND {WEST} <= {_BOX[2]!r} AND {NORTH} >= {_BOX[1]!r} AND {SOUTH} <= {_BOX[3]!r}")
def pf4(spark, d):
    x0, y0, x1, y1 = _BOX
    s = X.road_segments(spark, d).withColumns(geo.bounds(F.col("coords")))
    return s.where((F.col("max_lon") >= x0) & (F.col("min_lon") <= x1) & (F.col("max_lat") >= y0) & (F.col("min_lat") <= y1)).select("segment_id")


@query("q9_tile_features", f"""
  SELECT s.segment_id, coalesce(s.highway, 'unknown') AS highway, round(coalesce(c.composite_risk, 0e0), 6) AS risk, CAST(floor((mid_lon + 180e0) / 360e0 * 16384e0) AS INT) AS tx,
    CAST(floor((1e0 - ln(tan(radians(mid_lat)) + 1e0 / cos(radians(mid_lat))) / pi()) / 2e0 * 16384e0) AS INT) AS ty, c.score_id IS NULL AS is_stub
  FROM v_road_segments s LEFT JOIN (SELECT *, {LATEST} AS rn FROM v_segment_scores WHERE scoring_run_timestamp = TIMESTAMP '2025-06-21 12:00:00') c ON s.segment_id = c.segment_id AND c.rn = 1 WHERE s.city_id = 1""")
def q9(spark, d):
    """Features of zoom-14 tiles of one city at an hour: rows keyed by tile."""
    s = X.road_segments(spark, d).where("city_id = 1")
    j = s.join(lookups.snapped(X.segment_scores(spark, d).where("city_id = 1").drop("city_id"), F.lit("2025-06-21 12:10:00").cast("timestamp")), "segment_id", "left")
    return j.select("segment_id", F.coalesce("highway", F.lit("unknown")).alias("highway"), r6(F.coalesce("composite_risk", F.lit(0.0)), "risk"), geo.tile_x(F.col("mid_lon"), 14).alias("tx"), geo.tile_y(F.col("mid_lat"), 14).alias("ty"), F.col("score_id").isNull().alias("is_stub"))


@query("q11_static_tile_view", "SELECT segment_id, city_id, coalesce(highway, 'unknown') AS highway, CAST(CAST('0x' || substring(sha256(CAST(segment_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INT) AS bucket, round(mid_lon / 180e0 * 20037508.342789244e0, 3) AS mx, round(ln(tan(pi() / 4 + radians(mid_lat) / 2)) / pi() * 20037508.342789244e0, 3) AS my FROM v_road_segments")
def q11(spark, d):
    s = X.road_segments(spark, d)
    return s.select("segment_id", "city_id", F.coalesce("highway", F.lit("unknown")).alias("highway"), risk.static_bucket(F.col("segment_id")).alias("bucket"), F.round(geo.mercator_x(F.col("mid_lon")), 3).alias("mx"), F.round(geo.mercator_y(F.col("mid_lat")), 3).alias("my"))


@query("f35_city_tiles", """
  SELECT city_id, 14 AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (
    SELECT city_id, unnest(range(CAST(floor((min_lon + 180e0) / 360e0 * 16384e0) AS BIGINT), CAST(floor((max_lon + 180e0) / 360e0 * 16384e0) AS BIGINT) + 1)) AS x, min_lat, max_lat FROM v_cities) a,
    LATERAL (SELECT unnest(range(CAST(floor((1e0 - ln(tan(radians(max_lat)) + 1e0 / cos(radians(max_lat))) / pi()) / 2e0 * 16384e0) AS BIGINT), CAST(floor((1e0 - ln(tan(radians(min_lat)) + 1e0 / cos(radians(min_lat))) / pi()) / 2e0 * 16384e0) AS BIGINT) + 1)) AS y) b""")
def f35(spark, d):
    c = X.cities(spark, d)
    c = c.select("city_id", F.explode(F.sequence(geo.tile_x(F.col("min_lon"), 14), geo.tile_x(F.col("max_lon"), 14))).alias("x"), "min_lat", "max_lat")
    return c.select("city_id", F.lit(14).alias("z"), "x", F.explode(F.sequence(geo.tile_y(F.col("max_lat"), 14), geo.tile_y(F.col("min_lat"), 14))).alias("y"))


@query("f36_waypoints", """
  SELECT segment_id, CAST(i AS INT) AS sample_index, round(CASE WHEN n = 1 THEN 0.5e0 ELSE i / CAST(n - 1 AS DOUBLE) END, 6) AS fraction FROM (
    SELECT segment_id, n, unnest(range(n)) AS i FROM (SELECT segment_id, least(5, greatest(1, CAST(floor(list_sum(list_transform(range(1, len(coords)), lambda i: sqrt(power(coords[i + 1].lon - coords[i].lon, 2) + power(coords[i + 1].lat - coords[i].lat, 2)))) * 100000e0 / 50e0) AS INT) + 1)) AS n FROM v_road_segments) q) z""")
def f36(spark, d):
    return X.road_segments(spark, d).select("segment_id", F.explode(geo.waypoints(F.col("coords"))).alias("w")).select("segment_id", "w.sample_index", r6(F.col("w.fraction"), "fraction"))


@query("f4_angles", f"""
  SELECT segment_id, round(greatest(least(d, 360e0 - d), 1e0), 6) AS turn, round(least(d % 180e0, 180e0 - d % 180e0), 6) AS axis FROM (
    SELECT segment_id, abs(({azimuth_sql(*FIRST_LEG)}) - ({azimuth_sql(*LAST_LEG)})) AS d FROM v_road_segments) q""")
def f4(spark, d):
    t = topology.topology(X.road_segments(spark, d))
    a, b = F.col("start_bearing"), F.col("end_bearing")
    return t.select("segment_id", r6(geo.angle_between(a, b), "turn"), r6(geo.axis_angle(a, b), "axis"))


# Sun and glare: the oracle is the same published algorithm, spelt as nested SELECTs.
SUN = """
  SELECT *, CASE WHEN elev > 85e0 THEN 0e0 WHEN elev > 5e0 THEN (58.1e0 / tan(radians(elev)) - 0.07e0 / power(tan(radians(elev)), 3) + 0.000086e0 / power(tan(radians(elev)), 5)) / 3600e0
      WHEN elev > -0.575e0 THEN (1735e0 + elev * (-518.2e0 + elev * (103.4e0 + elev * (-12.79e0 + elev * 0.711e0)))) / 3600e0 ELSE -20.772e0 / tan(radians(elev)) / 3600e0 END + elev AS apparent,
    ((degrees(atan2(sin(radians(ha)), cos(radians(ha)) * sin(radians(lat)) - tan(radians(decl)) * cos(radians(lat)))) + 180e0) % 360e0 + 360e0) % 360e0 AS azimuth
  FROM (SELECT *, 90e0 - degrees(acos(greatest(-1e0, least(1e0, sin(radians(lat)) * sin(radians(decl)) + cos(radians(lat)) * cos(radians(decl)) * cos(radians(ha)))))) AS elev
  FROM (SELECT *, ((h * 60e0 + eqt + 4 * lon) % 1440e0 + 1440e0) % 1440e0 / 4 - 180e0 AS ha
  FROM (SELECT *, degrees(asin(sin(radians(tilt)) * sin(radians(seen)))) AS decl, 4 * degrees(y * sin(radians(2 * l0)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(radians(2 * l0)) - 0.5e0 * y * y * sin(radians(4 * l0)) - 1.25e0 * e * e * sin(radians(2 * m))) AS eqt
  FROM (SELECT *, power(tan(radians(tilt / 2)), 2) AS y
  FROM (SELECT *, l0 + sin(radians(m)) * (1.914602e0 - t * (0.004817e0 + 0.000014e0 * t)) + sin(radians(2 * m)) * (0.019993e0 - 0.000101e0 * t) + sin(radians(3 * m)) * 0.000289e0 - 0.00569e0 - 0.00478e0 * sin(radians(node)) AS seen,
      23e0 + (26e0 + (21.448e0 - t * (46.815e0 + t * (0.00059e0 - t * 0.001813e0))) / 60e0) / 60e0 + 0.00256e0 * cos(radians(node)) AS tilt
  FROM (SELECT *, (280.46646e0 + t * (36000.76983e0 + t * 0.0003032e0)) % 360e0 AS l0, 357.52911e0 + t * (35999.05029e0 - 0.0001537e0 * t) AS m, 0.016708634e0 - t * (0.000042037e0 + 0.0000001267e0 * t) AS e, 125.04e0 - 1934.136e0 * t AS node
  FROM (SELECT segment_id, h, mid_lat AS lat, mid_lon AS lon, axis, ((1750464000e0 + h * 3600e0) / 86400e0 + 2440587.5e0 - 2451545e0) / 36525e0 AS t FROM (
    SELECT segment_id, mid_lat, mid_lon, unnest(range(24)) AS h, """ + BEARING + """ AS axis FROM (SELECT *, start_lon AS x1, start_lat AS y1, end_lon AS x2, end_lat AS y2 FROM v_road_segments) s0) s) a) b) c) d) e1) f) g"""  # fmt: skip


def sunlit(spark, d):
    """All segments at the 24 hours of a day, with axis, sun azimuth and elevation."""
    s = X.road_segments(spark, d)
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    axis = geo.bearing(F.col("start_lon"), F.col("start_lat"), F.col("end_lon"), F.col("end_lat"))
    s = s.select("segment_id", "mid_lat", "mid_lon", axis.alias("axis"), hours.alias("h"))
    azimuth, elevation = solar.position(F.col("mid_lat"), F.col("mid_lon"), F.lit(1750464000.0) + F.col("h") * 3600.0)
    return s.select("segment_id", "h", "axis", azimuth.alias("azimuth"), elevation.alias("elevation"))


@query("f6_solar_position", f"SELECT segment_id, CAST(h AS INT) AS h, round(azimuth, 4) AS azimuth, round(apparent, 4) AS elevation FROM ({SUN}) q")
def f6(spark, d):
    return sunlit(spark, d).select("segment_id", "h", F.round("azimuth", 4).alias("azimuth"), F.round("elevation", 4).alias("elevation"))


AX = "abs(axis - azimuth) % 180e0"


@query("s1_glare", f"SELECT segment_id, CAST(h AS INT) AS h, round(CASE WHEN apparent < 0 THEN 0e0 ELSE greatest(0e0, least(1e0, power(cos(radians(least({AX}, 180e0 - {AX}))), 2) * (1e0 - sin(radians(apparent))))) END, 5) AS glare FROM ({SUN}) q")
def s1(spark, d):
    return sunlit(spark, d).select("segment_id", "h", F.round(solar.glare(geo.axis_angle(F.col("axis"), F.col("azimuth")), F.col("elevation")), 5).alias("glare"))


def scored_nodes(spark, d):
    """Nodes of the graph at 24 hours. Input is the local part of run A at the sampled hour before, which fades until the next sample."""
    s = X.segment_scores(spark, d).where(F.col("scoring_run_id").endswith("-A"))
    local = s.select("segment_id", F.col("hour_utc").alias("at"), F.greatest(F.lit(0.0), F.col("composite_risk") - F.col("propagation_uplift")).alias("x"))
    base = X.road_segments(spark, d).select("city_id", F.col("segment_id"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    base = base.withColumn("at", F.col("hour") - F.col("hour") % 6)
    fade = 1.0 - 0.1 * (F.col("hour") % 6)
    return base.join(local, ["segment_id", "at"], "left").select("city_id", "hour", F.col("segment_id").alias("node"), (F.coalesce("x", F.lit(0.0)) * fade).alias("input"))


NODES = """SELECT s.city_id, CAST(h.hour AS INT) AS hour, s.segment_id AS node, coalesce(greatest(0e0, c.composite_risk - c.propagation_uplift), 0e0) * (1e0 - 0.1e0 * (h.hour % 6)) AS input FROM v_road_segments s CROSS JOIN range(24) AS h(hour)
    LEFT JOIN v_segment_scores c ON c.segment_id = s.segment_id AND c.hour_utc = h.hour - h.hour % 6 AND c.scoring_run_id LIKE '%-A'"""
#: Personalised PageRank of common table expressions adj (city_id, src, dst) and nodes (city_id, hour, node, input): 100 rounds, then divided by the largest of each city and hour.
PAGERANK = """
  share AS (SELECT city_id, src, dst, 1e0 / count(*) OVER (PARTITION BY city_id, src) AS p FROM adj),
  tele AS (SELECT n.city_id, n.hour, n.node, coalesce(n.input / nullif(sum(n.input) OVER (PARTITION BY n.city_id, n.hour), 0), 0e0) AS t, o.src IS NULL AS dangling FROM nodes n LEFT JOIN (SELECT DISTINCT city_id, src FROM adj) o ON o.city_id = n.city_id AND o.src = n.node),
  pr AS (SELECT 0 AS k, city_id, hour, node, t AS pi FROM tele
    UNION ALL
    SELECT s.k + 1, t.city_id, t.hour, t.node, 0.15e0 * t.t + 0.85e0 * (coalesce(l.lost, 0e0) * t.t + coalesce(g.got, 0e0))
    FROM tele t CROSS JOIN (SELECT max(k) AS k FROM pr) s
    LEFT JOIN (SELECT p.city_id, p.hour, sum(p.pi) AS lost FROM pr p JOIN tele d ON d.city_id = p.city_id AND d.hour = p.hour AND d.node = p.node AND d.dangling GROUP BY 1, 2) l ON l.city_id = t.city_id AND l.hour = t.hour
    LEFT JOIN (SELECT p.city_id, p.hour, e.dst AS node, sum(p.pi * e.p) AS got FROM pr p JOIN share e ON e.city_id = p.city_id AND e.src = p.node GROUP BY 1, 2, 3) g ON g.city_id = t.city_id AND g.hour = t.hour AND g.node = t.node
    WHERE s.k < 100),
  lift AS (SELECT city_id, hour, node, coalesce(pi / nullif(max(pi) OVER (PARTITION BY city_id, hour), 0), 0e0) AS uplift FROM pr WHERE k = 100)"""


@query("g3_influence_k2", f"""
  WITH adj AS ({ADJ}), nodes AS ({NODES}),
  hops AS (SELECT src, dst, min(k) AS k FROM (SELECT src, dst, 1 AS k FROM adj UNION ALL SELECT a.src, b.dst, 2 FROM adj a JOIN adj b ON a.dst = b.src WHERE a.src <> b.dst) q GROUP BY 1, 2)
  SELECT n.city_id, n.hour, n.node, round(coalesce(sum(power(0.5e0, h.k) * m.input), 0e0) + 1e-9, 6) AS uplift FROM nodes n LEFT JOIN hops h ON h.dst = n.node LEFT JOIN nodes m ON m.node = h.src AND m.hour = n.hour GROUP BY 1, 2, 3""")
def g3(spark, d):
    edges = topology.adjacency(topology.topology(X.road_segments(spark, d)))
    return graph.propagate(scored_nodes(spark, d), edges, "influence-diffusion", k=2).select("city_id", "hour", "node", r6(F.col("uplift") + 1e-9, "uplift"))  # sums end in a five often; both sides round up


@query("g2_pagerank", f"WITH RECURSIVE adj AS ({ADJ}), nodes AS ({NODES}), {PAGERANK} SELECT city_id, hour, node, round(uplift, 6) AS uplift FROM lift")
def g2(spark, d):
    edges = topology.adjacency(topology.topology(X.road_segments(spark, d)))
    return graph.propagate(scored_nodes(spark, d), edges, "pagerank-diffusion").select("city_id", "hour", "node", r6("uplift"))


@query("g4_shortest_path", f"""
  WITH RECURSIVE adj AS (SELECT city_id, src, dst, 0.5e0 + 0.5e0 * ((src + dst) % 4) AS w FROM ({ADJ}) q), nodes AS ({NODES}),
  walk AS (SELECT src, dst, w AS dist FROM adj WHERE w <= 2e0 UNION SELECT k.src, a.dst, k.dist + a.w FROM walk k JOIN adj a ON a.src = k.dst WHERE k.dist + a.w <= 2e0),
  near AS (SELECT src, dst, min(dist) AS dist FROM walk WHERE src <> dst GROUP BY 1, 2)
  SELECT n.city_id, n.hour, n.node, round(coalesce(sum(exp(-0.5e0 * h.dist) * m.input), 0e0), 6) AS uplift FROM nodes n LEFT JOIN near h ON h.dst = n.node LEFT JOIN nodes m ON m.node = h.src AND m.hour = n.hour GROUP BY 1, 2, 3""")
def g4(spark, d):
    edges = topology.adjacency(topology.topology(X.road_segments(spark, d))).withColumn("weight", 0.5 + 0.5 * ((F.col("src") + F.col("dst")) % 4))
    return graph.propagate(scored_nodes(spark, d), edges, "weighted-shortest-path", radius=2.0, alpha=0.5).select("city_id", "hour", "node", r6("uplift"))


@query("a21_degree_and_neighbourhood", f"SELECT a.src AS segment_id, count(*) AS degree, round(avg(n.input), 6) AS mean FROM ({ADJ}) a JOIN ({NODES}) n ON n.node = a.dst AND n.hour = 12 GROUP BY 1")
def a21(spark, d):
    n = scored_nodes(spark, d).where("hour = 12").select(F.col("node").alias("dst"), "input")
    e = topology.adjacency(topology.topology(X.road_segments(spark, d))).select(F.col("src").alias("segment_id"), "dst")
    return e.join(n, "dst").groupBy("segment_id").agg(F.count("*").alias("degree"), r6(F.avg("input"), "mean"))


@query("f17_confidence", """
  SELECT segment_id, round(least(fresh, cover, model), 6) AS confidence, CASE WHEN fresh = least(fresh, cover, model) THEN 'freshness' WHEN cover = least(fresh, cover, model) THEN 'coverage' ELSE 'model' END AS limiter FROM (
    SELECT s.segment_id, CASE WHEN i.n IS NULL THEN 1e0 WHEN age <= 180 THEN 1e0 WHEN age >= 1080 THEN 0e0 ELSE (1080e0 - age) / 900e0 END AS fresh, least(1e0, coalesce(i.n, 0) / 5e0) AS cover, CASE WHEN i.n IS NULL THEN 0e0 ELSE 0.8e0 END AS model
    FROM v_road_segments s LEFT JOIN (SELECT segment_id, count(*) AS n, DATE '2024-06-01' - max(capture_date) AS age FROM v_segment_imagery GROUP BY 1) i ON s.segment_id = i.segment_id) q""")
def f17(spark, d):
    """Freshness, coverage and model certainty of imagery; without images coverage limits."""
    i = X.segment_imagery(spark, d).groupBy("segment_id").agg(F.count("*").alias("n"), F.datediff(F.lit("2024-06-01").cast("date"), F.max("capture_date")).alias("age"))
    s = X.road_segments(spark, d).select("segment_id").join(i, "segment_id", "left")
    none = F.col("n").isNull()
    value, limiter = risk.confidence(F.when(none, 1.0).otherwise(risk.freshness(F.col("age"))), risk.coverage(F.coalesce("n", F.lit(0))), F.when(none, 0.0).otherwise(0.8))
    return s.select("segment_id", r6(value, "confidence"), limiter.alias("limiter"))


@query("f21_time_functions", """
  SELECT event_id, date_trunc('hour', ts) + CASE WHEN extract(minute FROM ts) >= 30 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS snapped, CAST(extract(hour FROM ts) AS INT) AS target_hour,
    DATE '2025-01-01' + CAST(least(365, greatest(1, user_id)) - 1 AS INT) AS day FROM events""")
def f21(spark, d):
    ts = F.col("ts")
    return X.table(spark, d, "events").select("event_id", lookups.snap_hour(ts).cast("timestamp_ntz").alias("snapped"), risk.target_hour(ts).alias("target_hour"), risk.day_of_year(F.col("user_id"), 2025).alias("day"))


@query("f26_local_noon_hour", """
  SELECT city_id, CAST(CASE timezone WHEN 'Africa/Lagos' THEN 11 WHEN 'America/New_York' THEN 16 WHEN 'Asia/Kolkata' THEN 7 WHEN 'Europe/Berlin' THEN 10 ELSE 8 END AS INT) AS noon_utc FROM v_cities""")
def f26(spark, d):
    """UTC hour of local noon on 2025-06-21, half hours rounded up."""
    noon = F.lit("2025-06-21 12:00:00").cast("timestamp")
    minutes = (F.unix_timestamp(F.to_utc_timestamp(noon, F.col("timezone"))) - F.unix_timestamp(F.lit("2025-06-21 00:00:00").cast("timestamp"))) / 60.0
    return X.cities(spark, d).select("city_id", F.pmod(F.floor(minutes / 60.0 + 0.5).cast("int"), F.lit(24)).alias("noon_utc"))


@query("j13_segment_hours", "SELECT segment_id, TIMESTAMP '2025-06-21 00:00:00' + to_hours(CAST(h AS INT)) AS at FROM (SELECT segment_id, unnest(range(24)) AS h FROM v_road_segments) q")
def j13(spark, d):
    hours = F.explode(F.expr("sequence(TIMESTAMP_NTZ '2025-06-21 00:00:00', TIMESTAMP_NTZ '2025-06-21 23:00:00', INTERVAL 1 HOUR)"))
    return X.road_segments(spark, d).select("segment_id", hours.alias("at"))


GLARE = f"SELECT segment_id, CAST(h AS INT) AS h, CASE WHEN apparent < 0 THEN 0e0 ELSE greatest(0e0, least(1e0, power(cos(radians(least({AX}, 180e0 - {AX}))), 2) * (1e0 - sin(radians(apparent))))) END AS glare FROM ({SUN}) q"
LANE = f"SELECT s.segment_id, coalesce(avg(q.value), 0e0) AS value, CASE WHEN count(q.value) = 0 THEN 0e0 ELSE 1e0 - max(q.uncertainty) END AS confidence, count(q.value) = 0 AS is_stub FROM v_road_segments s LEFT JOIN ({IMG}) q ON s.segment_id = q.segment_id GROUP BY 1"


@query("s6_composite_run", f"""
  WITH RECURSIVE adj AS ({ADJ}),
  subs AS (SELECT j.city_id, j.segment_id, g.h AS hour, g.glare, l.value AS lane, j.score AS junction, least(1e0, r.raw) AS historical, l.is_stub, CASE WHEN l.is_stub THEN 1e0 ELSE least(1e0, l.confidence) END AS confidence
    FROM ({S3}) j JOIN ({GLARE}) g ON g.segment_id = j.segment_id JOIN ({LANE}) l ON l.segment_id = j.segment_id JOIN ({RAW}) r ON r.segment_id = j.segment_id),
  local AS (SELECT *, 0.35e0 * glare + 0.30e0 * lane + 0.20e0 * junction + 0.15e0 * historical AS local FROM subs),
  nodes AS (SELECT city_id, hour, segment_id AS node, local AS input FROM local), {PAGERANK}
  SELECT c.city_id, c.segment_id, c.hour, round(glare, 6) AS glare, round(lane, 6) AS lane_marking, round(junction, 6) AS junction_complexity, round(historical, 6) AS historical, round(local, 6) AS local,
    round(p.uplift, 6) AS propagation_uplift, round(local + p.uplift, 6) AS composite_risk, round(confidence, 6) AS confidence, is_stub AS is_stub_lane_marking
  FROM local c JOIN lift p ON p.city_id = c.city_id AND p.hour = c.hour AND p.node = c.segment_id""")
def s6(spark, d):
    """The scoring run of one day, all cities and hours: four sub-scores, propagation of the local part at every hour, composite, confidence."""
    run = scoring.scoring_run(X.road_segments(spark, d), X.segment_imagery(spark, d), X.incidents(spark, d), "2025-06-21")
    return run.select("city_id", "segment_id", "hour", *(r6(c) for c in ("glare", "lane_marking", "junction_complexity", "historical", "local", "propagation_uplift", "composite_risk", "confidence")), "is_stub_lane_marking")


@query("s8_row_confidence", f"SELECT segment_id, round(CASE WHEN is_stub THEN 0e0 ELSE least(1e0, confidence) END, 6) AS confidence, is_stub AS is_stub_lane_marking FROM ({LANE}) l")
def s8(spark, d):
    """A run of lane markings alone: a row without a real sub-score has no confidence."""
    run = scoring.scoring_run(X.road_segments(spark, d), X.segment_imagery(spark, d), X.incidents(spark, d), "2025-06-21", hours=(12,), strategy="influence-diffusion", weights={"lane_marking": 1.0}, k=1)
    return run.select("segment_id", r6("confidence"), "is_stub_lane_marking")


@query("s7_provisional_run", f"""
  SELECT j.city_id, j.segment_id, g.h AS hour, round(CASE WHEN l.is_stub THEN (g.glare + j.score) / 2 ELSE (l.value + g.glare + j.score) / 3 END, 6) AS composite_risk, round(CASE WHEN l.is_stub THEN 1e0 ELSE least(1e0, l.confidence) END, 6) AS confidence
  FROM ({S3}) j JOIN ({GLARE}) g ON g.segment_id = j.segment_id JOIN ({LANE}) l ON l.segment_id = j.segment_id""")
def s7(spark, d):
    run = scoring.provisional_run(X.road_segments(spark, d), X.segment_imagery(spark, d), X.incidents(spark, d), "2025-06-21")
    return run.select("city_id", "segment_id", "hour", r6("composite_risk"), r6("confidence"))


SUN_AT = SUN.replace("SELECT segment_id, h, mid_lat AS lat", "SELECT segment_id, h, stamp, mid_lat AS lat").replace("(1750464000e0 + h * 3600e0)", "epoch(stamp)")
SUN_AT = SUN_AT.replace("SELECT segment_id, mid_lat, mid_lon, unnest(range(24)) AS h,", "SELECT segment_id, mid_lat, mid_lon, stamp, CAST(extract(hour FROM stamp) AS INT) AS h,").replace("FROM v_road_segments) s0)", "FROM scored) s0)")


@query("q3_segment_detail", f"""
  WITH picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY abs(epoch(scoring_run_timestamp) - epoch(TIMESTAMP '2025-06-21 08:20:00')), inserted_at DESC, scoring_run_timestamp DESC, score_id DESC) AS rn FROM v_segment_scores) q WHERE rn = 1),
  scored AS (SELECT s.*, p.scoring_run_timestamp AS stamp FROM v_road_segments s JOIN picked p ON p.segment_id = s.segment_id),
  sun AS (SELECT segment_id, azimuth, apparent FROM ({SUN_AT}) q),
  img AS (SELECT segment_id, count(*) AS n, max(capture_date) AS newest FROM v_segment_imagery GROUP BY 1),
  parts AS (SELECT s.segment_id, s.city_id, s.osm_way_id, p.*  EXCLUDE (segment_id, city_id), p.segment_id IS NULL AS none, r.propagation_algorithm_version AS v, coalesce(i.n, 0) AS n, i.newest, u.azimuth, u.apparent,
      CASE WHEN i.newest IS NULL THEN 0e0 WHEN DATE '2024-06-01' - i.newest <= 180 THEN 1e0 WHEN DATE '2024-06-01' - i.newest >= 1080 THEN 0e0 ELSE (1080e0 - (DATE '2024-06-01' - i.newest)) / 900e0 END AS fresh,
      least(1e0, coalesce(i.n, 0) / 5e0) AS cover, 1e0 - CASE WHEN p.confidence IS NULL THEN 1e0 ELSE greatest(0e0, 1e0 - p.confidence) END AS model
    FROM v_road_segments s LEFT JOIN picked p ON p.segment_id = s.segment_id LEFT JOIN v_scoring_runs r ON r.scoring_run_id = p.scoring_run_id AND r.city_id = s.city_id LEFT JOIN img i ON i.segment_id = s.segment_id LEFT JOIN sun u ON u.segment_id = s.segment_id)
  SELECT segment_id, city_id, osm_way_id, none AS is_stub, round(composite_risk, 6) AS composite_risk, CASE WHEN NOT none THEN round(greatest(0e0, composite_risk - propagation_uplift), 6) END AS local_contribution, round(coalesce(propagation_uplift, 0e0), 6) AS propagation_uplift,
    regexp_extract(v, '^(.*)-([^-]*)$', 1) AS algorithm, regexp_extract(v, '^(.*)-([^-]*)$', 2) AS algorithm_version, round(sub_score_lane_marking, 6) AS lane_marking, round(sub_score_glare, 6) AS glare, round(sub_score_junction_complexity, 6) AS junction_complexity, round(sub_score_historical, 6) AS historical,
    coalesce(is_stub_lane_marking, true) AS is_stub_lane_marking, n AS image_count, newest AS newest_image, round(least(fresh, cover, model), 6) AS confidence, CASE WHEN fresh = least(fresh, cover, model) THEN 'freshness' WHEN cover = least(fresh, cover, model) THEN 'coverage' ELSE 'model' END AS limiter,
    round(azimuth, 4) AS sun_azimuth, round(apparent, 4) AS sun_elevation
  FROM parts""")
def q3(spark, d):
    """Detail of every segment near a time; the stub's hashed values are left out here (f28_stub_hash has them)."""
    day = lambda x: F.lit(x).cast("date")
    out = detail.segment_detail(X.road_segments(spark, d), X.segment_scores(spark, d), X.scoring_runs(spark, d), X.segment_imagery(spark, d), F.lit("2025-06-21 08:20:00").cast("timestamp"), day("2024-06-01"))
    real = lambda c: F.when(~F.col("is_stub"), r6(F.col(c))).alias(c)
    return out.select(
        "segment_id", "city_id", "osm_way_id", "is_stub", real("composite_risk"), real("local_contribution"), r6("propagation_uplift"), "algorithm", "algorithm_version", *(real(c) for c in detail.SUBS),
        "is_stub_lane_marking", "image_count", "newest_image", r6("confidence"), "limiter", F.round("sun_azimuth", 4).alias("sun_azimuth"), F.round("sun_elevation", 4).alias("sun_elevation"),
    )


def clip_sql(legs: str, keep: str = "segment_id") -> str:
    """legs: keep, part, tx, ty (a zoom-14 tile) and its place in the tile as px, py, qx, qy."""
    side = lambda p, d, f: f"CASE WHEN {d} = 0 THEN CASE WHEN {p} BETWEEN -256e0 AND 4352e0 THEN {0 if f == 'least' else 1}e0 ELSE {2 if f == 'least' else 1}e0 END ELSE {f}((-256e0 - {p}) / {d}, (4352e0 - {p}) / {d}) END"
    at = lambda a, b, t, n: f"CAST(round({a} + {t} * ({b} - {a})) AS INT) AS {n}"
    cut = f"SELECT *, greatest(0e0, {side('px', '(qx - px)', 'least')}, {side('py', '(qy - py)', 'least')}) AS s, least(1e0, {side('px', '(qx - px)', 'greatest')}, {side('py', '(qy - py)', 'greatest')}) AS e FROM ({legs}) l"
    return f"SELECT {keep}, tx, ty, part, {at('px', 'qx', 's', 'x1')}, {at('py', 'qy', 's', 'y1')}, {at('px', 'qx', 'e', 'x2')}, {at('py', 'qy', 'e', 'y2')} FROM ({cut}) c WHERE s < e"


def _unit(lon: str, lat: str, a: str) -> str:
    return f"(({lon} + 180e0) / 360e0 * 16384e0 - tx) * 4096e0 AS {a}x, ((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * 16384e0 - ty) * 4096e0 AS {a}y"


_TX, _TY = "CAST(floor(({0} + 180e0) / 360e0 * 16384e0) AS BIGINT)", "CAST(floor((1e0 - ln(tan(radians({0})) + 1e0 / cos(radians({0}))) / pi()) / 2e0 * 16384e0) AS BIGINT)"
TILED = f"""SELECT *, unnest(range({_TY.format('n')}, {_TY.format('s')} + 1)) AS ty FROM (SELECT *, unnest(range({_TX.format('w')}, {_TX.format('e')} + 1)) AS tx FROM (
  SELECT *, {WEST} AS w, {EAST} AS e, {SOUTH} AS s, {NORTH} AS n FROM v_road_segments) b) a"""
LEGS = f"SELECT segment_id, city_id, tx, ty, part, {_unit('coords[part + 1].lon', 'coords[part + 1].lat', 'p')}, {_unit('coords[part + 2].lon', 'coords[part + 2].lat', 'q')} FROM (SELECT *, CAST(unnest(range(len(coords) - 1)) AS INT) AS part FROM ({TILED}) t) l0"


def tiled(spark, d, zoom: int = 14):
    """Segments by the tiles their boxes meet, with what is left of their lines there; rows without geometry are dropped."""
    return vector_tiles.tiled(X.road_segments(spark, d), zoom).withColumns({"tx": F.col("x").cast("long"), "ty": F.col("y").cast("long")})


@query("snk7_tile_geometry", clip_sql(LEGS))
def snk7(spark, d):
    """Clipped and quantised geometry of every zoom-14 tile, rows keyed by tile."""
    return tiled(spark, d).select("segment_id", "tx", "ty", F.inline("geometry"))


@query("snk7_tile_bytes")
def snk7_tile_bytes(spark, d):
    """Every zoom-14 tile as bytes, with class and latest noon risk of its segments; tests decode them with a reader of their own."""
    s = X.segment_scores(spark, d)
    latest = lookups.snapped(s.drop("city_id"), F.lit("2025-06-21 12:10:00").cast("timestamp"))
    rows = tiled(spark, d).join(latest.select("segment_id", "composite_risk"), "segment_id", "left")
    rows = rows.withColumn("highway", F.coalesce("highway", F.lit("unknown"))).withColumn("is_stub", F.col("composite_risk").isNull())
    return vector_tiles.encode(rows, "road_segments", "segment_id", ["highway", "composite_risk", "is_stub"])


@query("q9_tile_function", f"""
  SELECT s.segment_id, coalesce(s.highway, 'unknown') AS highway, round(coalesce(c.composite_risk, 0e0), 6) AS risk, round(coalesce(c.sub_score_glare, 0e0), 6) AS glare, c.score_id IS NULL AS is_stub
  FROM v_road_segments s LEFT JOIN (SELECT *, {LATEST} AS rn FROM v_segment_scores WHERE scoring_run_timestamp = TIMESTAMP '2025-06-21 12:00:00') c ON s.segment_id = c.segment_id AND c.rn = 1
  WHERE s.city_id = 1 AND {EAST} >= {_BOX[0]!r} AND {WEST} <= {_BOX[2]!r} AND {NORTH} >= {_BOX[1]!r} AND {SOUTH} <= {_BOX[3]!r}""")
def q9_tile_function(spark, d):
    """A tile of a city at a time, by the table function of SQL."""
    c = X.cities(spark, d)
    table_functions.register(spark, c, X.road_segments(spark, d).withColumns(geo.bounds(F.col("coords"))), X.segment_scores(spark, d))
    rows = spark.sql("SELECT t.* FROM road_segments_tile(13, 2488, 3030, 'america', TIMESTAMP '2025-06-21 12:10:00') AS t")
    return rows.select("segment_id", "highway", r6(F.col("composite_risk"), "risk"), r6("glare"), "is_stub")


@query("q10_tile_delta_function", f"""
  SELECT s.segment_id, round(b.composite_risk - a.composite_risk, 6) + 0e0 AS composite_delta, round(coalesce(b.sub_score_historical, 0e0) - coalesce(a.sub_score_historical, 0e0), 6) + 0e0 AS historical_delta
  FROM v_road_segments s JOIN v_segment_scores a ON a.segment_id = s.segment_id AND a.scoring_run_id = '1-A' AND a.hour_utc = 12 JOIN v_segment_scores b ON b.segment_id = s.segment_id AND b.scoring_run_id = '1-B' AND b.hour_utc = 12
  WHERE s.city_id = 1 AND {EAST} >= {_BOX[0]!r} AND {WEST} <= {_BOX[2]!r} AND {NORTH} >= {_BOX[1]!r} AND {SOUTH} <= {_BOX[3]!r}""")
def q10_tile_delta_function(spark, d):
    """Run against run in a tile, by the table function of SQL."""
    c = X.cities(spark, d)
    table_functions.register(spark, c, X.road_segments(spark, d).withColumns(geo.bounds(F.col("coords"))), X.segment_scores(spark, d))
    return spark.sql("SELECT * FROM road_segments_tile_delta(13, 2488, 3030, '1-A', '1-B', 'america')").select("segment_id", r6("composite_delta"), r6("historical_delta"))


@query("q10_tile_delta", f"""
  SELECT g.tx, g.ty, g.segment_id, round(b.composite_risk - a.composite_risk, 6) + 0e0 AS composite_delta, round(b.sub_score_historical - a.sub_score_historical, 6) + 0e0 AS historical_delta
  FROM (SELECT DISTINCT segment_id, city_id, tx, ty FROM ({clip_sql(LEGS, 'segment_id, city_id')}) c) g
  JOIN v_segment_scores a ON a.segment_id = g.segment_id AND a.scoring_run_id = concat(CAST(g.city_id AS VARCHAR), '-A') AND a.hour_utc = 12
  JOIN v_segment_scores b ON b.segment_id = g.segment_id AND b.scoring_run_id = concat(CAST(g.city_id AS VARCHAR), '-B') AND b.hour_utc = 12""")
def q10(spark, d):
    """Run B against run A of each city at noon, by tile, for segments with geometry in the tile."""
    s = X.segment_scores(spark, d).where("hour_utc = 12").drop("city_id")
    side = lambda t, n: s.where(F.col("scoring_run_id").endswith(f"-{t}")).select("segment_id", F.col("composite_risk").alias(f"c{n}"), F.col("sub_score_historical").alias(f"h{n}"))
    g = tiled(spark, d).select("tx", "ty", "segment_id")
    return g.join(side("A", 0).join(side("B", 1), "segment_id"), "segment_id").select("tx", "ty", "segment_id", r6(F.col("c1") - F.col("c0"), "composite_delta"), r6(F.col("h1") - F.col("h0"), "historical_delta"))


@query("a3_incident_window", "SELECT city_id, min(incident_at) AS first_at, max(incident_at) AS last_at FROM v_incidents GROUP BY 1")
def a3(spark, d):
    return X.incidents(spark, d).groupBy("city_id").agg(F.min("incident_at").alias("first_at"), F.max("incident_at").alias("last_at"))


@query("l6_max_segments", "SELECT segment_id, city_id FROM v_road_segments ORDER BY segment_id LIMIT 250")
def l6(spark, d):
    """The cap of an imagery job: its first segments."""
    return X.road_segments(spark, d).select("segment_id", "city_id").orderBy("segment_id").limit(250)


@query("f33_short_id", "SELECT segment_id, substring(sha256(CAST(segment_id AS VARCHAR)), 1, 8) AS short FROM v_road_segments")
def f33(spark, d):
    return X.road_segments(spark, d).select("segment_id", risk.short_id(F.sha2(F.col("segment_id").cast("string"), 256)).alias("short"))


@query("f40_arcs", """
  SELECT score_id, k.name, round(k.i * pi() / 2, 6) AS start_angle, round((k.i + 1) * pi() / 2, 6) AS end_angle, 40e0 AS inner_radius, 96e0 AS outer_radius, round(CASE k.i WHEN 0 THEN sub_score_lane_marking WHEN 1 THEN sub_score_glare WHEN 2 THEN sub_score_junction_complexity ELSE sub_score_historical END, 6) AS value
  FROM v_segment_scores CROSS JOIN (VALUES (0, 'lane_marking'), (1, 'glare'), (2, 'junction_complexity'), (3, 'historical')) AS k(i, name)""")
def f40(spark, d):
    a = risk.arcs([(n, F.col(f"sub_score_{n}")) for n in detail.SUBS])
    return X.segment_scores(spark, d).select("score_id", F.inline(a)).select("score_id", "name", r6("start_angle"), r6("end_angle"), "inner_radius", "outer_radius", r6("value"))
