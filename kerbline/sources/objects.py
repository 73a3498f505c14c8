"""Objects of a store that Spark reaches: bytes as rows, and a model that every worker loads once."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_LOADED: dict[tuple[str, str], object] = {}


def read(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """object_key (within path), length, content, sha256; with keys (object_key), only of these, so that no other object is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    key = F.regexp_replace("path", "^.*?" + path.split("://")[-1].strip("/").replace(".", "[.]") + "/", "")
    rows = files.withColumn("object_key", key)
    if keys is not None:  # by name first: content is read of what is left
        rows = rows.join(keys.select("object_key").distinct(), "object_key", "left_semi")
    return rows.select("object_key", "length", "content", F.sha2("content", 256).alias("sha256"))


def model(spark: SparkSession, path: str, load: Callable[[bytes], T]) -> Callable[[], T]:
    """Ships a file to all executors; the function returned gives load(its bytes), once for each Python worker."""
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def get() -> T:
        at = SparkFiles.get(name)
        if (at, name) not in _LOADED:
            _LOADED[at, name] = load(Path(at).read_bytes())
        return _LOADED[at, name]

    return get
