"""Incident pages as a provider's REST service returns them, landed as JSON under year=... folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import risk

PAGE = "features array<struct<attributes: map<string, string>, geometry: struct<x: double, y: double>>>, exceededTransferLimit boolean"
# Attribute names of the service.
ID, AT, SEVERITY, LAT, LON = "CRASH_NUMB", "CRASH_DATE", "CRASH_SEVERITY_DESCR", "LAT", "LON"
#: Attributes that go to the metadata map.
META = ("MAX_INJR_SVRTY_CL",)


def read_pages(spark: SparkSession, path: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """One row for each feature; years outside the range are pruned by partition."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    if first_year is not None and "year" in pages.columns:
        pages = pages.where(F.col("year").between(first_year, last_year))
    return pages.select(F.explode("features").alias("f")).select("f.attributes", "f.geometry")


def in_years(rows: DataFrame, first: int, last: int, at: str = "incident_at") -> DataFrame:
    """Rows of these years: by partition if there is a year column, and as a range of the time itself, which files and row groups are skipped by."""
    kind = dict(rows.dtypes)[at]
    edge = lambda y: F.lit(f"{y}-01-01 00:00:00").cast(kind)
    out = rows.where((F.col(at) >= edge(first)) & (F.col(at) < edge(last + 1)))
    return out.where(F.col("year").between(first, last)) if "year" in rows.columns else out


def marshal(features: DataFrame, provider: str, city_id: int, start=None, end=None) -> DataFrame:
    """Incidents of features: no id or time, or no place: dropped; geometry before attributes; closed date window."""
    a = F.col("attributes")
    at = F.timestamp_millis(F.expr(f"try_cast(attributes['{AT}'] AS BIGINT)"))
    number = lambda k: F.expr(f"try_cast(attributes['{k}'] AS DOUBLE)")
    out = features.select(
        F.lit(provider).alias("provider"), a[ID].alias("provider_incident_id"), F.lit(city_id).cast("long").alias("city_id"),
        F.coalesce("geometry.y", number(LAT)).alias("lat"), F.coalesce("geometry.x", number(LON)).alias("lon"), at.alias("incident_at"),
        risk.raw_severity(a[SEVERITY]).alias("severity"), F.map_filter(a, lambda k, v: k.isin(*META) & v.isNotNull()).alias("metadata"),
    )
    out = out.where("provider_incident_id IS NOT NULL AND incident_at IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    if start is not None:
        out = out.where(F.to_date("incident_at").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out
