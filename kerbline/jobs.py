"""Jobs over a folder of tables: cities, road segments, incidents, imagery pages, scoring. python -m kerbline.jobs BASE JOB ...

Tables are committed whole (committed.py), so a job that dies leaves what was there. Every job may be run again: cities and
segments are upserts, incidents and images are appended unless they are there, and a scoring run gets an id of its own. supervise() runs named jobs one after the other, remembers which are done, and retries.
"""

from __future__ import annotations

import argparse
import datetime as dt
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import committed
from .functions import geo
from .operators import merge, scoring
from .session import session
from .shared import cut, release
from .sources import cities, imagery, incidents, osm, rest

LINE = "array<struct<lon: double, lat: double>>"
SEGMENTS = f"segment_id long, osm_way_id long, highway string, lanes string, coords {LINE}, min_lon double, min_lat double, max_lon double, max_lat double, city_id long"
INCIDENTS = "provider string, provider_incident_id string, lat double, lon double, incident_at timestamp, severity string, metadata map<string,string>, city_id long"
IMAGERY = "provider string, provider_image_id string, segment_id long, sample_index int, capture_date date, heading_deg double, logits array<float>, city_id long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, base: str, name: str, schema: str, city_id: int | None = None) -> DataFrame:
    """A table of the folder as last committed, empty before that; with a city only its parts are read."""
    rows = committed.read(spark, f"{base}/{name}", schema, None if city_id is None else {"city_id": city_id})
    return rows if city_id is None else rows.where(F.col("city_id") == city_id)


def city(spark: SparkSession, base: str, slug: str) -> dict:
    row = read(spark, base, "cities", CITIES).where(F.col("slug") == slug).first()
    if row is None:
        raise LookupError(f"no such city: {slug}")
    return row.asDict()


CITIES = f"{cities.SCHEMA}, city_id long"


def seed_cities(spark: SparkSession, base: str, *paths: str) -> dict[str, str]:
    """Upserts cities by slug; returns what became of each."""
    new = cities.load(spark, *paths).withColumn("city_id", F.abs(F.xxhash64("slug")))
    old = read(spark, base, "cities", CITIES)
    status = {r["slug"]: r["status"] for r in merge.classify(old, new, "slug", ("name", "min_lon", "min_lat", "max_lon", "max_lat", "default_zoom", "timezone")).collect()}  # one row a city
    committed.update(spark, f"{base}/cities", CITIES, lambda now: merge.upsert(now, new, ["slug"], "slug"))
    return status


def seed(spark: SparkSession, base: str, slug: str, extract: str) -> int:
    """Upserts the road segments of a city from an extract, lines with all their vertices; other cities' parts are not touched."""
    c = city(spark, base, slug)
    ways = osm.read_ways(spark, extract, tuple(c[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat")))
    box = [v.alias(k) for k, v in geo.bounds(F.col("coords")).items()]
    new = ways.select(F.col("osm_way_id").alias("segment_id"), "osm_way_id", F.col("attrs")["highway"].alias("highway"), F.col("attrs")["lanes"].alias("lanes"), "coords", *box, F.lit(c["city_id"]).alias("city_id"))
    return committed.update(spark, f"{base}/road_segments", SEGMENTS, lambda now: merge.upsert(now, new, ["osm_way_id"], "segment_id"), {"city_id": c["city_id"]}).count()


def ingest_incidents(spark: SparkSession, base: str, slug: str, pages: str, start: str, end: str, provider: str = "pages") -> int:
    """Appends the incidents of a closed date window that are not there yet. pages: a folder of landed pages, or a service's address."""
    c = city(spark, base, slug)
    box = tuple(c[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat"))
    raw = rest.incident_features(spark, pages, box, int(start[:4]), int(end[:4])) if pages.startswith("http") else incidents.read_pages(spark, pages, int(start[:4]), int(end[:4]))
    seen = incidents.marshal(raw, provider, c["city_id"], start, end)
    seen = seen.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).select(*(x.split()[0] for x in INCIDENTS.split(", ")))
    new = cut(merge.insert_ignore(read(spark, base, "incidents", INCIDENTS, c["city_id"]), seen, ("provider", "provider_incident_id"), "incident_at"), "incidents")
    found = new.count()
    if found:
        committed.append(new, f"{base}/incidents", {"city_id": c["city_id"]})
    release(new)
    return found


def image_requests(spark: SparkSession, base: str, slug: str, max_segments: int | None = None) -> DataFrame:
    """Boxes to ask an imagery provider for, around the waypoints of a city's segments (the first max_segments of them)."""
    s = read(spark, base, "road_segments", SEGMENTS, city(spark, base, slug)["city_id"])
    s = s if max_segments is None else s.orderBy("segment_id").limit(max_segments)
    at = s.select("segment_id", "coords", F.explode(geo.waypoints(F.col("coords"))).alias("w"))
    at = at.select("segment_id", "w.sample_index", geo.interpolate(F.col("coords"), F.col("w.fraction")).alias("p"))
    return imagery.waypoint_boxes(at.select("segment_id", "sample_index", "p.lon", "p.lat"))


REQUESTS = "asked string, segment_id long, sample_index int, lon double, lat double, min_lon double, min_lat double, max_lon double, max_lat double"
REFUSED = "asked string, segment_id long, sample_index int, error string, city_id long"


def ingest_images(
    spark: SparkSession, base: str, slug: str, start: str, end: str, fetch: Callable[[DataFrame], DataFrame] | str, perceive: Callable[[DataFrame], DataFrame] | None = None,
    provider: str = "images", batch: int = 1000, max_segments: int | None = None,
) -> int:
    """Asks for images around every waypoint of a city and keeps those of a closed date window; returns how many are new.

    Waypoints become files of ``batch`` requests, once for each window; a stream over these files fetches, keeps and commits file
    by file. A run that stops goes on with the first file it had not committed, and a file that is taken twice adds nothing. Refused
    waypoints are recorded and asked again by the next call. fetch: a service's address, or a function of requests (rest.IMAGES);
    perceive: a function that adds logits to images, without which they are stored with none and scored as not there.
    """
    c = city(spark, base, slug)
    scope = {"city_id": c["city_id"]}
    window = f"{start}..{end}"
    folder = f"{base}/image_requests/city_id={c['city_id']}"
    before = (spark.read.schema(REQUESTS).json(folder) if _exists(spark, folder) else spark.createDataFrame([], REQUESTS)).where(F.col("asked") == window)
    refused = read(spark, base, "image_refusals", REFUSED, c["city_id"]).where(F.col("asked") == window)
    keys = ["segment_id", "sample_index"]
    tried = before.groupBy(*keys).count().withColumnRenamed("count", "times").join(refused.groupBy(*keys).agg(F.count("*").alias("failed")), keys, "left")
    done = tried.where(F.col("times") > F.coalesce("failed", F.lit(0))).select(*keys)  # asked once more than refused: answered, or still to be taken
    boxes = image_requests(spark, base, slug, max_segments).join(done, keys, "left_anti").withColumn("asked", F.lit(window))
    columns = [x.split()[0] for x in REQUESTS.split(", ")]
    cut_boxes = cut(boxes.select(*columns), "requests")
    if not cut_boxes.isEmpty():
        cut_boxes.write.mode("append").option("maxRecordsPerFile", batch).json(folder)
    release(cut_boxes)
    ask = (lambda df: rest.images(df, fetch)) if isinstance(fetch, str) else fetch
    added = []

    def keep(requests: DataFrame, _: int) -> None:
        asked = cut(requests.where(F.col("asked") == window), "asked")
        answers = cut(ask(asked), "answers")
        found = imagery.nearest_waypoint(answers.where("error IS NULL"), asked.select(*keys, F.col("lon").alias("at_lon"), F.col("lat").alias("at_lat")))
        images = imagery.marshal(found, provider, start, end).withColumn("city_id", F.lit(c["city_id"]))
        images = perceive(images) if perceive else images.withColumn("logits", F.lit(None).cast("array<float>"))
        rows = images.select(*(x.split()[0] for x in IMAGERY.split(", ")))
        there = read(spark, base, "imagery", IMAGERY, c["city_id"]).join(asked.select("segment_id").distinct(), "segment_id", "left_semi")
        new = cut(merge.insert_ignore(there, rows, ("provider", "provider_image_id", "segment_id"), "sample_index"), "images")
        failed = answers.where("error IS NOT NULL").select(F.lit(window).alias("asked"), *keys, "error", F.lit(c["city_id"]).alias("city_id")).dropDuplicates(keys)
        n = new.count()
        if n:
            committed.append(new, f"{base}/imagery", scope)
        if not failed.isEmpty():
            committed.append(failed, f"{base}/image_refusals", scope)
        added.append(n)
        release(asked, answers, new)

    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).json(folder)
    where = f"{base}/_checkpoints/images/{c['city_id']}/{window}"
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    return sum(added)


def score(spark: SparkSession, base: str, slug: str, date: str, strategy: str = "pagerank-diffusion", model: str = "none", snapshot: str | None = None) -> str:
    """Scores a city for the 24 hours of a day and appends the rows in one commit; returns the run's id.

    The run itself is recorded first, so that a run that fails can be seen. Its imagery window is that of all images there are.
    """
    c = city(spark, base, slug)
    own = lambda name, schema: read(spark, base, name, schema, c["city_id"])
    seen = read(spark, base, "imagery", IMAGERY).agg(F.min("capture_date").alias("a"), F.max("capture_date").alias("b")).first()
    first, last = (seen["a"], seen["b"]) if seen["a"] is not None else (dt.date.fromisoformat(date),) * 2
    run = (uuid.uuid4().hex, c["city_id"], dt.datetime.now(dt.UTC), model, dt.date.fromisoformat(snapshot or date), first, last + dt.timedelta(days=1), f"{strategy}-0.1.0", None)
    committed.append(spark.createDataFrame([run], scoring.RUNS), f"{base}/scoring_runs", {"city_id": c["city_id"]})
    told = dict(zip((x.split()[0] for x in scoring.RUNS.split(", ")), run, strict=True))
    rows = scoring.scoring_run(own("road_segments", SEGMENTS), own("imagery", IMAGERY).where("logits IS NOT NULL"), own("incidents", INCIDENTS), date, strategy=strategy)
    scoring.append_scores(scoring.history(rows, told, date), f"{base}/segment_scores", {"city_id": c["city_id"], "scoring_run_id": run[0]})
    return run[0]


def supervise(spark: SparkSession, jobs: Mapping[str, Callable[[], object]], state: str, attempts: int = 3, backoff: float = 2.0, cap: float = 300.0, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Runs jobs by name: done (now or in an earlier call, as the state folder says) or failed after so many attempts; a failure stops no other job."""
    done = f"{state}/done"
    before = {r["name"] for r in spark.read.schema("name string").parquet(done).collect()} if _exists(spark, done) else set()  # one row a job
    out = {}
    for name, job in jobs.items():
        if name in before:
            out[name] = "done before"
            continue
        for k in range(attempts):
            try:
                job()
            except Exception as error:
                out[name] = f"failed: {error}"
                if k + 1 < attempts:
                    sleep(min(backoff * 2**k, cap))
            else:
                out[name] = "done"
                spark.createDataFrame([(name,)], "name string").write.mode("append").parquet(done)
                break
    return out


def main(argv: list[str] | None = None) -> object:
    p = argparse.ArgumentParser(prog="kerbline.jobs")
    p.add_argument("base", help="folder of the tables")
    jobs = p.add_subparsers(dest="job", required=True)
    for name, *own in (("cities", "files+"), ("seed", "slug", "extract"), ("incidents", "slug", "pages", "start", "end"), ("requests", "slug", "out"), ("imagery", "slug", "start", "end", "service"), ("score", "slug", "date")):
        sub = jobs.add_parser(name)
        for x in own:
            sub.add_argument(x.rstrip("+"), **({"nargs": "+"} if x.endswith("+") else {}))
        if name in ("requests", "imagery"):
            sub.add_argument("--max-segments", type=int)
        if name == "score":
            sub.add_argument("--strategy", default="pagerank-diffusion")
    a = p.parse_args(argv)
    spark = session()
    if a.job == "cities":
        return seed_cities(spark, a.base, *a.files)
    if a.job == "seed":
        return seed(spark, a.base, a.slug, a.extract)
    if a.job == "incidents":
        return ingest_incidents(spark, a.base, a.slug, a.pages, a.start, a.end)
    if a.job == "requests":
        return image_requests(spark, a.base, a.slug, a.max_segments).write.json(a.out)
    if a.job == "imagery":
        return ingest_images(spark, a.base, a.slug, a.start, a.end, a.service, max_segments=a.max_segments)
    return score(spark, a.base, a.slug, a.date, a.strategy)


if __name__ == "__main__":
    print(main())
