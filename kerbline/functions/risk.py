"""Score expressions: incidents, junctions, confidence, composite, display."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
SEVERITIES = ("fatal", "injury", "property_damage_only", "unknown")
SEVERITY_WEIGHT = {"fatal": 3.0, "injury": 2.0, "property_damage_only": 1.0, "unknown": 1.0}
RAW_SEVERITY = {
    "Fatal injury": "fatal",
    "Non-fatal injury": "injury",
    "Non-fatal injury - Suspected serious injury": "injury",
    "Non-fatal injury - Suspected minor injury": "injury",
    "Non-fatal injury - Possible injury": "injury",
    "Property damage only (none injured)": "property_damage_only",
    "Not Reported": "unknown",
    "Unknown": "unknown",
    "Reported but invalid": "unknown",
}
CLASS_RANK = {
    "service": 1,
    "residential": 2,
    "living_street": 2,
    "unclassified": 2,
    "tertiary": 3,
    "tertiary_link": 3,
    "secondary": 4,
    "secondary_link": 4,
    "primary": 5,
    "primary_link": 5,
    "trunk": 6,
    "trunk_link": 6,
    "motorway": 7,
    "motorway_link": 7,
}
WEIGHTS = {"glare": 0.35, "lane_marking": 0.30, "junction_complexity": 0.20, "historical": 0.15}
RUN_SENTINEL = "none-phase-2"


def lookup(values: dict, key: Column, default) -> Column:
    """Of a literal map; small dictionaries only."""
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def severity_weight(severity: Column) -> Column:
    return lookup(SEVERITY_WEIGHT, severity, 1.0)


def raw_severity(text: Column) -> Column:
    return lookup(RAW_SEVERITY, F.trim(text), "unknown")


def incident_weight(distance_m: Column, age_days: Column, severity: Column, radius_m: float = 50.0, half_life_days: float = 365.0) -> Column:
    """Gaussian kernel in distance (sigma half the radius) times halving with age (never below 0) times severity."""
    sigma = radius_m / 2
    kernel = F.exp(-F.pow(distance_m, 2) / (2 * sigma * sigma))
    return kernel * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days) * severity_weight(severity)


def degree_score(legs: Column) -> Column:
    return F.when(legs <= 1, 0.0).otherwise(clamp((legs - 2) / 3.0))


def merge_score(angle: Column) -> Column:
    return clamp((90.0 - angle) / 90.0)


def lane_score(delta: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), delta / 3.0), F.lit(0.0))


def junction_score(legs: Column, angle: Column, lanes: Column, ranks: Column) -> Column:
    total = 0.30 * degree_score(legs) + 0.30 * merge_score(angle) + 0.20 * lane_score(lanes) + 0.20 * lane_score(ranks)
    return clamp(total)


def local_aggregate(glare: Column, lane: Column, junction: Column, historical: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return WEIGHTS["glare"] * zero(glare) + WEIGHTS["lane_marking"] * zero(lane) + WEIGHTS["junction_complexity"] * zero(junction) + WEIGHTS["historical"] * zero(historical)


def freshness(age_days: Column) -> Column:
    return F.when(age_days <= 180, 1.0).when(age_days >= 1080, 0.0).otherwise((1080.0 - age_days) / 900.0)


def coverage(actual: Column, target: int = 5) -> Column:
    return F.least(F.lit(1.0), actual / float(target))


def confidence(fresh: Column, cover: Column, model: Column) -> tuple[Column, Column]:
    """Smallest component and its name; ties go to freshness, then coverage, then model."""
    least = F.least(fresh, cover, model)
    return least, F.when(fresh == least, "freshness").when(cover == least, "coverage").otherwise("model")


def version_name(v: Column) -> Column:
    """Part before the last dash; the whole if there is none; null for the sentinel."""
    return F.when(v == RUN_SENTINEL, F.lit(None)).when(~F.contains(v, F.lit("-")), v).otherwise(F.regexp_extract(v, "^(.*)-([^-]*)$", 1))


def version_number(v: Column) -> Column:
    return F.when(v == RUN_SENTINEL, F.lit(None)).when(~F.contains(v, F.lit("-")), F.lit("")).otherwise(F.regexp_extract(v, "^(.*)-([^-]*)$", 2))


def colour_bucket(v: Column, stub: Column) -> Column:
    """0 to 4, or -1 for stubs and values that are not finite."""
    return F.when(stub | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), -1).otherwise(F.least(F.floor(F.greatest(v, F.lit(0.0)) * 5), F.lit(4)).cast("int"))


def delta_class(d: Column) -> Column:
    return F.when(F.abs(d) < 0.01, "neutral").when(d >= 0.15, "heavy_increase").when(d > 0, "increase").when(d <= -0.15, "heavy_decrease").otherwise("decrease")


def delta_width(d: Column) -> Column:
    return 1.5 + clamp(F.abs(d) / 0.3) * 6.5


def signed3(d: Column) -> Column:
    text = F.format_string("%+.3f", d)
    return F.when(text == "-0.000", "+0.000").otherwise(text)


def stub_hash(text: Column, salt: str) -> Column:
    """xxHash64 with seed 0 of salt and text, as a double in [0, 1): Catalyst's own expression, whose seed F.xxhash64 fixes at 42."""
    from pyspark.sql.classic.column import Column as Classic
    from pyspark.sql import SparkSession

    jvm = SparkSession.active()._jvm
    sc = SparkSession.active().sparkContext
    text = F.concat(F.lit(salt), text)
    expr = jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(text._jc)
    seq = jvm.scala.jdk.javaapi.CollectionConverters.asScala(sc._gateway.jvm.java.util.ArrayList([expr])).toSeq()
    h = Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))
    whole = F.when(h >= 0, h.cast("double")).otherwise(h.cast("double") + F.lit(2.0**64))
    return whole / F.lit(2.0**64)


def stub_bucket(u: Column) -> Column:
    return F.least(F.floor(u * 5), F.lit(4)).cast("int")


def epoch_day(millis: Column) -> Column:
    """The UTC day of milliseconds since 1970."""
    return F.to_date(F.timestamp_millis(millis))


def day_range(first: Column, last: Column) -> Column:
    """A half-open range of days, as struct<start, end_excl>."""
    return F.struct(F.to_date(first).alias("start"), F.date_add(F.to_date(last), 1).alias("end_excl"))


def backoff(attempt: Column, base: float = 2.0, cap: float = 300.0) -> Column:
    """Seconds to wait after an attempt (from 1): doubled each time, up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def bar_width(value: Column, scale: float, most: float = 100.0) -> Column:
    """Per cent of a bar, within its ends."""
    return clamp(value * scale, 0.0, most)


def day_of_year(n: Column, year: int) -> Column:
    """The n-th day of a year, n within 1 and 365."""
    return F.date_add(F.lit(f"{year}-01-01").cast("date"), (F.least(F.lit(365), F.greatest(F.lit(1), n)) - 1).cast("int"))


def target_hour(at: Column, noon: str = "2025-06-21 12:00:00") -> Column:
    """UTC hour of a time, that of noon without one."""
    return F.hour(F.coalesce(at, F.lit(noon).cast("timestamp_ntz")))


def static_bucket(key: Column, buckets: int = 5) -> Column:
    """A bucket that depends on the key alone: the first 32 bits of its digest, evenly spread."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def arcs(values: list[tuple[str, Column]], inner: float = 40.0, outer: float = 96.0) -> Column:
    """Equal sectors of a full turn, in the order given: array<struct<name, start_angle, end_angle, inner_radius, outer_radius, value>>."""
    turn = 2 * math.pi / len(values)
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i * turn).alias("start_angle"), F.lit((i + 1) * turn).alias("end_angle"), F.lit(inner).alias("inner_radius"), F.lit(outer).alias("outer_radius"), v.alias("value")) for i, (n, v) in enumerate(values)))
