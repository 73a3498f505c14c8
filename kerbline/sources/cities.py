"""City configuration: validated records as a table."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession

SLUG = re.compile(r"^[a-z0-9]+(-[a-z0-9]+)*$")
SCHEMA = "slug string, name string, min_lon double, min_lat double, max_lon double, max_lat double, default_zoom int, timezone string"


def check(city: Mapping) -> dict:
    """The record as a row; ValueError says what is wrong with it."""
    box = list(city.get("bbox", ()))
    wrong = []
    if not SLUG.match(str(city.get("slug", ""))):
        wrong.append("slug")
    if not city.get("name"):
        wrong.append("name")
    if len(box) != 4 or not (-180 <= box[0] < box[2] <= 180 and -90 <= box[1] < box[3] <= 90):
        wrong.append("bbox")
    if not 1 <= int(city.get("default_zoom", 0)) <= 22:
        wrong.append("default_zoom")
    if city.get("timezone") not in available_timezones():
        wrong.append("timezone")
    if wrong:
        raise ValueError(f"city {city.get('slug')!r}: {', '.join(wrong)}")
    return {"slug": city["slug"], "name": city["name"], **dict(zip(("min_lon", "min_lat", "max_lon", "max_lat"), map(float, box), strict=True)), "default_zoom": int(city["default_zoom"]), "timezone": city["timezone"]}


def table(spark: SparkSession, cities: Iterable[Mapping]) -> DataFrame:
    rows = [check(c) for c in cities]
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in SCHEMA.split(", ")) for r in rows], SCHEMA)


def load(spark: SparkSession, *paths: str) -> DataFrame:
    """From YAML or JSON files on the driver."""
    import json
    from pathlib import Path

    def read(p: str) -> Mapping:
        text = Path(p).read_text()
        if p.endswith(".json"):
            return json.loads(text)
        import yaml

        return yaml.safe_load(text)

    return table(spark, [read(p) for p in paths])
