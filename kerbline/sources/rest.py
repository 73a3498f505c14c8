"""Paged REST services as Spark sources: incidents by year as a data source, images by box as a mapped fetch.

A year is a partition of its own and is paged by the task that reads it, until the service says that nothing is left. Years are
told as options, so those that no row is wanted of are not asked for; conditions are not pushed to the source, as Spark 4.1 lets all
scans of one load share what the last of them pushed, so that a union of two years would read one of them twice. Server errors and broken connections are tried
again with growing pauses, client errors are not; a task that is lost is run again by Spark and asks its pages anew.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import ship

# Parameters of feature services, and the place of a year's layer in their address.
INCIDENT_QUERY = {"where": "1=1", "geometryType": "esriGeometryEnvelope", "inSR": "4326", "outFields": "*", "returnGeometry": "true", "outSR": "4326", "f": "json"}
IMAGE_FIELDS = "id,captured_at,compass_angle,camera_parameters,thumb_1024_url,computed_geometry"


class Pace:
    """At most so many requests a minute, after a first burst of as many: one for each task."""

    def __init__(self, per_minute: float):
        self.most, self.rate = per_minute, per_minute / 60.0
        self.left, self.at = per_minute, time.monotonic()

    def wait(self, sleep=time.sleep) -> None:
        now = time.monotonic()
        self.left, self.at = min(self.most, self.left + (now - self.at) * self.rate), now
        if self.left < 1:
            sleep((1 - self.left) / self.rate)
            self.left, self.at = 1.0, time.monotonic()
        self.left -= 1


def get_json(url: str, params: dict, pace: Pace | None = None, attempts: int = 5, backoff: float = 0.5, timeout: float = 30.0, sleep=time.sleep) -> dict:
    """The answer as a dict. Server errors, broken connections and answers cut short are tried again; client errors raise at once."""
    whole = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for k in range(attempts):
        if pace is not None:
            pace.wait(sleep)
        try:
            with urllib.request.urlopen(whole, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as error:
            if error.code < 500 or k + 1 == attempts:
                raise
        except (OSError, ValueError):
            if k + 1 == attempts:
                raise
        sleep(backoff * 2**k)
    raise RuntimeError("unreachable")


def pages(url: str, params: dict, size: int, **how) -> Iterator[list[dict]]:
    """The features of page after page, until one is empty, is not full, or does not say that more are left."""
    offset = 0
    while True:
        answer = get_json(url, params | {"resultRecordCount": size, "resultOffset": offset}, **how)
        features = answer.get("features") or []
        if features:
            yield features
        if len(features) < size or not answer.get("exceededTransferLimit"):
            return
        offset += len(features)


@dataclass
class Year(InputPartition):
    year: int


class IncidentReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.box = options["url"], options["box"]
        self.size, self.attempts, self.backoff = int(options.get("page_size", 1000)), int(options.get("attempts", 5)), float(options.get("backoff", 0.5))
        self.per_minute = float(options.get("per_minute", 600))
        self.years = list(range(int(options["first_year"]), int(options["last_year"]) + 1))

    def partitions(self) -> list[InputPartition]:
        return [Year(y) for y in self.years]

    def read(self, partition: Year | None) -> Iterator[tuple]:
        if partition is None:  # no year was asked for
            return
        url, pace = self.url.replace("{year}", str(partition.year)), Pace(self.per_minute)
        for features in pages(url, INCIDENT_QUERY | {"geometry": self.box}, self.size, pace=pace, attempts=self.attempts, backoff=self.backoff):
            for f in features:
                told = {k: v if v is None or isinstance(v, str) else json.dumps(v) for k, v in (f.get("attributes") or {}).items()}
                at = f.get("geometry")
                yield partition.year, told, None if at is None else (at.get("x"), at.get("y"))


class IncidentPages(DataSource):
    """Features of a service with a layer a year. Options: url (with {year}), box, first_year, last_year; page_size, attempts, backoff, per_minute."""

    @classmethod
    def name(cls) -> str:
        return "incident_pages"

    def schema(self) -> str:
        return "year int, attributes map<string, string>, geometry struct<x: double, y: double>"

    def reader(self, schema) -> IncidentReader:
        return IncidentReader(self.options)


def incident_features(spark: SparkSession, url: str, box: tuple[float, float, float, float], first_year: int, last_year: int, **options) -> DataFrame:
    """year, attributes, geometry of the years asked for, as the service has them."""
    ship(spark)
    spark.dataSource.register(IncidentPages)
    told = {"url": url, "box": ",".join(map(str, box)), "first_year": first_year, "last_year": last_year} | options
    return spark.read.format("incident_pages").options(**told).load()


IMAGES = "segment_id long, sample_index int, id string, captured_at long, compass_angle double, camera_parameters array<double>, thumb_1024_url string, lon double, lat double, error string"


def images(boxes: DataFrame, url: str, token: str | None = None, limit: int = 10, per_minute: float = 6000, attempts: int = 5, backoff: float = 0.5) -> DataFrame:
    """What the service has in the box of each waypoint; a waypoint it refuses has a row with the error and no id.

    Each task keeps its own pace: the rate is shared out by the number of partitions of boxes.
    """
    ship(boxes.sparkSession)
    share = per_minute / max(1, boxes.rdd.getNumPartitions())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(share)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.string(), pa.float64(), pa.float64(), pa.string()]
        names = [c.split()[0] for c in IMAGES.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for w in b.to_pylist():
                box = ",".join(f"{w[k]:.6f}" for k in ("min_lon", "min_lat", "max_lon", "max_lat"))
                params = {"bbox": box, "fields": IMAGE_FIELDS, "limit": limit} | ({"access_token": token} if token else {})
                key = (w["segment_id"], w["sample_index"])
                try:
                    found = get_json(url, params, pace, attempts, backoff).get("data") or []
                except (OSError, ValueError) as error:
                    rows.append((*key, *[None] * 7, str(error)[:200]))
                    continue
                for x in found:
                    lon, lat = ((x.get("computed_geometry") or {}).get("coordinates") or (None, None))[:2]
                    rows.append((*key, str(x["id"]), x.get("captured_at"), x.get("compass_angle"), x.get("camera_parameters"), x.get("thumb_1024_url"), lon, lat, None))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

    return boxes.select("segment_id", "sample_index", *(F.col(k).cast("double") for k in ("min_lon", "min_lat", "max_lon", "max_lat"))).mapInArrow(run, IMAGES)
