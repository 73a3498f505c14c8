"""Helpers that the corpus operators share: tables, lineage cuts in the shared folder, worker set-up."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, release, shared_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_spread(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], least: int = 1000) -> DataFrame:
    """many joined with few on keys, where no key's rows meet in one task.

    few has one row for each key and n, how many rows of many have that key; it is read three times, so it should be written
    out. Keys of more than a bound of rows are dealt to several places by the columns ``by``, and few's row goes to each. The
    bound is a two-thousandth of all rows or ``least``, so two thousand keys at most are beyond it: what is broadcast is bounded.
    """
    total = few.agg(F.sum("n")).first()[0] or 0
    most = max(least, -(-total // 2000))
    places = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(few.where(F.col("n") > most).select(*keys, places.alias("_places")))
    spot = F.when(F.col("_places").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("_places"))).cast("int")
    dealt = many.join(hot, keys, "left").withColumn("_spot", spot).drop("_places")
    copied = few.withColumn("_spot", F.explode(F.sequence(F.lit(0), places - 1)))
    return dealt.join(copied, [*keys, "_spot"]).drop("_spot", "n")


def aside(docs: DataFrame, *names: str):
    """docs with the columns of these names (in any case) renamed out of the way, and a function that gives a result docs' columns back."""
    taken = {c.lower() for c in docs.columns} | set(names)
    new = {}
    for c in docs.columns:
        if c.lower() in names:
            other = c
            while other.lower() in taken:
                other = f"_{other}"
            taken.add(other.lower())
            new[c] = other
    return docs.withColumnsRenamed(new), lambda df: df.select(*(F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs run inside, where a row may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


_KEPT: dict = {}


def kept(key: tuple, make):
    """What make() returns, kept by this Python worker for its next tasks until another key is asked for.

    Workers outlive jobs, so tables of words would add up from operator to operator if each kept its own.
    """
    if _KEPT.get("key") != key:
        forget()
        _KEPT.update(key=key, value=make())
    return _KEPT["value"]


def forget() -> None:
    """Drops what this worker keeps, and gives back memory that Arrow holds without using it."""
    import pyarrow as pa

    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def alone(run):
    """run, a function of mapInArrow, in workers that keep nothing of other operators meanwhile."""

    def go(batches):
        forget()
        yield from run(batches)
        forget()

    return go


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_groups(batches, keys: list[str]):
    """Cuts a stream of batches, sorted by integer key columns, into tables that never end inside a group."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        key = tuple(c[-1] for c in cols)
        same = np.ones(batch.num_rows, bool)
        for c, v in zip(cols, key, strict=True):
            same &= c == v
        start = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if start == 0 and key == last:
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, start)] if start else held
        if whole:
            yield pa.Table.from_batches(whole)
        held, last = [batch.slice(start)], key
    if held:
        yield pa.Table.from_batches(held)
