"""Incremental incident ingestion: a file stream, deduplicated within a watermark, appended without what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ("provider", "provider_incident_id")
SCHEMA = "provider string, provider_incident_id string, city_id long, lat double, lon double, incident_at timestamp, severity string"


def stream(spark: SparkSession, path: str, delay: str = "7 days", max_files: int = 100) -> DataFrame:
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)
    return rows.withWatermark("incident_at", delay).dropDuplicatesWithinWatermark(list(KEYS))


def append_new(batch: DataFrame, target: str) -> None:
    """Appends the rows of a batch whose key the target lacks; a batch that is replayed adds nothing.

    Of the target only the batch's cities are read, and of these the time that the batch covers: an incident keeps its time.
    """
    from ..operators.merge import insert_ignore

    spark = batch.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    first, last = batch.agg(F.min("incident_at"), F.max("incident_at")).first()
    old = spark.read.schema(SCHEMA).parquet(target) if there else spark.createDataFrame([], SCHEMA)
    timeless = F.col("incident_at").isNull()
    old = old.where(timeless if first is None else timeless | F.col("incident_at").between(F.lit(first), F.lit(last)))  # reaches the scan: files and row groups are skipped
    cities = F.broadcast(batch.select("city_id").distinct())  # one row a city; prunes the partitions that are read
    insert_ignore(old.join(cities, "city_id", "left_semi"), batch, KEYS, "incident_at").write.mode("append").partitionBy("city_id").parquet(target)


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Processes what is there and stops; starts where it stopped when called again."""
    rows = stream(spark, path, **options)
    return rows.writeStream.foreachBatch(lambda df, _: append_new(df, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Incidents by city and hour, for rows of a stream or of a table."""
    return rows.withWatermark("incident_at", delay).groupBy(F.window("incident_at", "1 hour"), "city_id").agg(F.count("*").alias("n"))
