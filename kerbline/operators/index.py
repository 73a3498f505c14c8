"""Dense numbers for rows, from 0 within each key, without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

BROADCAST_ROWS = 65_536


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows with place (by order, within keys) and total (rows of the keys); and what was stored for it.

    Rows are range partitioned, numbered within their partition, written, and shifted by the rows of their key in the partitions
    before. The numbers depend on the rows alone, not on how they were partitioned, but for rows that are equal in all of order.
    """
    keys = list(keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_row")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    runs = dealt.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)  # one row for each partition at most
    runs = runs.select(*keys, "_part", "_first", "_n", F.sum("_n").over(own.orderBy("_part")).alias("_upto"), F.sum("_n").over(own).alias("total"))
    runs = cut(runs, "runs")
    few = F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs
    placed = dealt.withColumn("_part", part).join(few, [*keys, "_part"])
    placed = placed.withColumn("place", F.col("_at") - F.col("_first") + F.col("_upto") - F.col("_n"))
    return placed.drop("_at", "_part", "_first", "_upto", "_n"), [dealt, runs]
