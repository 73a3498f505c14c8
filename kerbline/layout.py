"""Files along a space-filling curve: what is near on the map is near on disk, and files that a box cannot meet are not opened.

Rows are range partitioned and sorted by the Morton number of their box's centre, so each file covers a small part of the map. The
box of every file is written into the commit beside it; readers of a box choose files by it, and within a file row groups are
skipped by their statistics.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import committed

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")


def spread(v: Column) -> Column:
    """The 31 bits of a number with a zero between each two."""
    v = v.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(lon: Column, lat: Column) -> Column:
    """Place on the Z curve: bits of longitude and latitude, 31 each, in turn."""
    most = float(2**31 - 1)
    unit = lambda v, low, width: F.greatest(F.lit(0.0), F.least(F.lit(most), F.floor((v - low) / width * (most + 1)))).cast("long")
    return spread(unit(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(unit(lat, -90.0, 180.0)), 1))


def stage(df: DataFrame, path: str, files: int, scope: Mapping | None = None) -> dict:
    """Stages rows with a box in about so many files along the curve; the part tells each file's box."""
    centre = morton((F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2)
    part = committed.stage(df.withColumn("_z", centre).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z"), path, scope)
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data/{part['folder']}").select(*BOX, F.col("_metadata.file_name").alias("file"))
    edges = [F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")]
    part["files"] = {r["file"]: list(r)[1:] for r in written.groupBy("file").agg(*edges).collect()}  # one row a file
    return part


def write(df: DataFrame, path: str, files: int, scope: Mapping | None = None) -> int:
    """Replaces the rows of a scope, or all, by df, clustered."""
    part = stage(df, path, files, scope)
    return committed.commit(df.sparkSession, path, lambda now: [*(p for p in now if dict(p["scope"]) != part["scope"]), part])


def files_of(spark: SparkSession, path: str, box: tuple[float, float, float, float], scope: Mapping | None = None) -> list[str]:
    """Files that may hold rows whose box meets this one; all of a part that was not clustered."""
    x0, y0, x1, y1 = box
    out = []
    for p in committed.parts(spark, path)[1]:
        if committed.within(p, scope or {}):
            at = f"{path}/data/{p['folder']}"
            out += [f"{at}/{f}" for f, (a, b, c, d) in p["files"].items() if c >= x0 and a <= x1 and d >= y0 and b <= y1] if "files" in p else [at]
    return out


def read_box(spark: SparkSession, path: str, schema: str, box: tuple[float, float, float, float], scope: Mapping | None = None) -> DataFrame:
    """Rows whose box meets this one."""
    files = files_of(spark, path, box, scope)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    x0, y0, x1, y1 = box
    return rows.where((F.col("max_lon") >= x0) & (F.col("min_lon") <= x1) & (F.col("max_lat") >= y0) & (F.col("min_lat") <= y1))
