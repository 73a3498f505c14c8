"""Upserts and insert-ignore on natural keys, for tables that are rewritten or appended to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins: rows of new replace rows of old of the same key; within new the largest ``order`` counts."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows of new to append: one a key (the smallest ``order``), none whose key is in old."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    return skip_existing(old, first, keys).select(*new.columns)


def skip_existing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of new whose key is not in old."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def ingest_summary(old: DataFrame, new: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """One row about new: seen, skipped (key in old), inserted, first_at and last_at of all that was seen."""
    held = old.select(*keys).distinct().withColumn("_held", F.lit(True))
    tagged = new.join(held, list(keys), "left")
    there = F.col("_held").isNotNull()
    return tagged.agg(F.count("*").alias("seen"), F.count_if(there).alias("skipped"), F.count_if(~there).alias("inserted"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def classify(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, status: inserted, updated, unchanged or absent, by a full outer join and null-safe comparison."""
    o = old.select(F.col(key).alias("_k"), F.struct(*columns).alias("_o"))
    n = new.select(key, F.struct(*columns).alias("_n"))
    j = n.join(o, F.col(key) == F.col("_k"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}"))
    status = F.when(F.col("_k").isNull(), "inserted").when(F.col(key).isNull(), "absent").when(same, "unchanged").otherwise("updated")
    return j.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def bump_freshness(sources: DataFrame, seen: DataFrame, at: str) -> DataFrame:
    """sources (name, last_ingested_at) with the largest ``at`` of seen (name, at) where there is one."""
    top = seen.groupBy("name").agg(F.max(at).alias("_at"))
    return sources.join(top, "name", "left").withColumn("last_ingested_at", F.coalesce("_at", "last_ingested_at")).drop("_at")
