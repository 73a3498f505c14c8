"""Tile queries as table functions of SQL: SELECT * FROM road_segments_tile(14, 4960, 6062, 'new-town', TIMESTAMP '2025-06-21 12:10:00').

register() makes them temporary functions over the tables given. Arguments may be columns of a lateral join. An unknown
city has no rows, a null time means the latest scores, any other is snapped to its hour, as in lookups.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUBS = ("lane_marking", "glare", "junction_complexity", "historical")

#: Corners of the tile z, x, y, and the rows of a city whose box meets it.
_LON = "({x} / power(2D, z) * 360D - 180D)"
_LAT = "degrees(atan(sinh(pi() * (1D - 2D * {y} / power(2D, z)))))"
_MEETS = f"""s.max_lon >= {_LON.format(x='x')} AND s.min_lon <= {_LON.format(x='(x + 1)')} AND s.max_lat >= {_LAT.format(y='(y + 1)')} AND s.min_lat <= {_LAT.format(y='y')}"""
_CITY = "JOIN kerbline_cities c ON c.city_id = s.city_id AND c.slug = city"


def _tile() -> str:
    stored = ", ".join(f"'{n}', sub_score_{n}" for n in SUBS)
    order = "struct(inserted_at, scoring_run_timestamp, score_id)"
    hit = "at IS NULL OR scoring_run_timestamp = date_trunc('HOUR', at + INTERVAL '30' MINUTE)"
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION road_segments_tile(z INT, x INT, y INT, city STRING, at TIMESTAMP DEFAULT NULL)
RETURNS TABLE (segment_id BIGINT, highway STRING, composite_risk DOUBLE, {", ".join(f"{n} DOUBLE" for n in SUBS)}, scored_at TIMESTAMP, is_stub BOOLEAN)
RETURN SELECT s.segment_id, coalesce(s.highway, 'unknown'), coalesce(p.b.composite_risk, 0D), {", ".join(f"coalesce(p.b.{n}, 0D)" for n in SUBS)}, p.b.scoring_run_timestamp, p.b IS NULL
  FROM kerbline_segments s {_CITY}
  LEFT JOIN (SELECT segment_id, max_by(named_struct('composite_risk', composite_risk, {stored}, 'scoring_run_timestamp', scoring_run_timestamp), {order}) AS b
    FROM kerbline_scores WHERE {hit} GROUP BY segment_id) p ON p.segment_id = s.segment_id
  WHERE {_MEETS}"""


def _delta() -> str:
    change = ", ".join(f"coalesce(b.sub_score_{n}, 0D) - coalesce(a.sub_score_{n}, 0D)" for n in SUBS)
    return f"""
CREATE OR REPLACE TEMPORARY FUNCTION road_segments_tile_delta(z INT, x INT, y INT, run_a STRING, run_b STRING, city STRING, at TIMESTAMP DEFAULT NULL)
RETURNS TABLE (segment_id BIGINT, highway STRING, composite_delta DOUBLE, {", ".join(f"{n}_delta DOUBLE" for n in SUBS)})
RETURN SELECT s.segment_id, coalesce(s.highway, 'unknown'), b.composite_risk - a.composite_risk, {change}
  FROM kerbline_segments s {_CITY}
  JOIN kerbline_scores a ON a.segment_id = s.segment_id AND a.scoring_run_id = run_a AND a.hour_utc = hour(coalesce(at, TIMESTAMP '2025-06-21 12:00:00'))
  JOIN kerbline_scores b ON b.segment_id = s.segment_id AND b.scoring_run_id = run_b AND b.hour_utc = a.hour_utc
  WHERE {_MEETS}"""


def register(spark: SparkSession, cities: DataFrame, segments: DataFrame, scores: DataFrame) -> None:
    """cities: city_id, slug. segments: segment_id, city_id, highway and a box (min_lon, ...). scores: the score history."""
    cities.select("city_id", "slug").createOrReplaceTempView("kerbline_cities")
    segments.select("segment_id", "city_id", "highway", "min_lon", "min_lat", "max_lon", "max_lat").createOrReplaceTempView("kerbline_segments")
    scores.createOrReplaceTempView("kerbline_scores")
    spark.sql(_tile())
    spark.sql(_delta())
