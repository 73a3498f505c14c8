"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName("kerbline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", shuffle_partitions) if shuffle_partitions else b
    return b.getOrCreate()
