"""Lineage cuts in the folder that driver and executors share, and what Python workers need to import this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where only the driver's sys.path holds it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one of our own in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="kerbline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kerbline_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what cut() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_kerbline_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def join_dealt(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], least: int = 1000) -> DataFrame:
    """many joined with few on keys; a key with more rows of many than a bound is dealt to several places by the columns ``by``, with few's rows copied to each.

    The bound is a two-thousandth of all rows of many, or ``least``: so at most two thousand keys are beyond it, and what is broadcast is bounded.
    """
    counts = cut(many.groupBy(*keys).agg(F.count("*").alias("_n")), "counts")
    most = max(least, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // 2000))
    hot = F.broadcast(counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_places")))
    places = F.coalesce("_places", F.lit(1))
    dealt = many.join(hot, keys, "left").withColumn("_spot", F.pmod(F.xxhash64(*by), places).cast("int")).drop("_places")
    copied = few.join(hot, keys, "left").withColumn("_spot", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    return dealt.join(copied, [*keys, "_spot"]).drop("_spot")
