"""Extracts fetched to a folder that driver and executors share, kept while the size upstream says that they have not changed."""

from __future__ import annotations

import datetime as dt
import email.utils
import os
import shutil
import urllib.error
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "source_url string, local_path string, osm_snapshot_date date, size_bytes long, sha256 string, cached boolean"


def _head(url: str, timeout: float) -> dict[str, str]:
    """Headers of the upstream file, none if it does not answer."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            return dict(answer.headers.items())
    except OSError:
        return {}


def _day(headers: dict[str, str], path: Path) -> dt.date:
    """The day the server says the file was last changed, else that of the file itself."""
    said = headers.get("Last-Modified")
    try:
        return email.utils.parsedate_to_datetime(said).date()
    except (TypeError, ValueError):
        return dt.datetime.fromtimestamp(path.stat().st_mtime, dt.UTC).date()


def fetch(url: str, into: str, timeout: float = 30.0) -> dict:
    """Downloads url to the file into unless a file of the size upstream is there; a download that breaks off leaves what was there.

    Returns source_url, local_path, osm_snapshot_date, size_bytes and cached.
    """
    if not url:
        raise ValueError("no url")
    path = Path(into)
    path.parent.mkdir(parents=True, exist_ok=True)
    headers = _head(url, timeout)
    same = path.exists() and headers.get("Content-Length", "").isdigit() and path.stat().st_size == int(headers["Content-Length"])
    if not same:
        new = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer, new.open("wb") as out:
                shutil.copyfileobj(answer, out, 1 << 16)
                headers = dict(answer.headers.items())
                size = headers.get("Content-Length", "")
                if size.isdigit() and out.tell() != int(size):
                    raise urllib.error.ContentTooShortError(f"{url}: {out.tell()} of {size} bytes", None)
            os.replace(new, path)
        finally:
            new.unlink(missing_ok=True)
    return {"source_url": url, "local_path": str(path), "osm_snapshot_date": _day(headers, path), "size_bytes": path.stat().st_size, "cached": same}


def snapshot(spark: SparkSession, url: str, into: str, timeout: float = 30.0) -> DataFrame:
    """fetch() as a row, with the digest of the file as Spark reads it."""
    told = fetch(url, into, timeout)
    row = spark.createDataFrame([(told["source_url"], told["local_path"], told["osm_snapshot_date"], told["size_bytes"], told["cached"])], "source_url string, local_path string, osm_snapshot_date date, size_bytes long, cached boolean")
    digest = spark.read.format("binaryFile").load(f"file://{Path(into).resolve()}").select("length", F.sha2("content", 256).alias("sha256"))
    return row.join(digest, row["size_bytes"] == digest["length"]).select(*(c.split()[0] for c in SNAPSHOT.split(", ")))  # one row each
