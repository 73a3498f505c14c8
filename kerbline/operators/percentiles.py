"""Exact order statistics of groups of any size: ranks are found by histograms that are refined where the rank lies.

A pass counts the values of each open range in equal bins (combined before the shuffle, so a group costs a row a bin) and keeps the
bin that holds the rank, as the smallest and largest value found in it. A range is closed when these are equal, or when so few
values are left that they are sorted in place. No task holds a group's values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut, release


def ranks(values: DataFrame, keys: Sequence[str], wanted: DataFrame, bins: int = 1024, few: int = 4096) -> DataFrame:
    """values: keys, x (nulls don't count). wanted: keys, rank (from 1). Returns keys, rank, x; ranks beyond a group's size have no row."""
    keys = list(keys)
    held = values.where("x IS NOT NULL").select(*keys, "x")
    whole = held.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    state = cut(wanted.select(*keys, "rank").distinct().join(whole, keys).where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n"))).withColumn("below", F.lit(0).cast("long")), "ranks")
    still = (F.col("lo") < F.col("hi")) & (F.col("n") > few)
    while not state.where(still).isEmpty():
        open_ = state.where(still).select(*keys, "lo", "hi").distinct()
        share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        counted = held.join(open_, keys).where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi", bin_.alias("bin"))
        counted = counted.agg(F.count("*").alias("m"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        upto = F.sum("m").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin"))  # a row for each bin at most
        counted = counted.withColumn("upto", upto)
        inner = state.where(still).join(counted, [*keys, "lo", "hi"]).where((F.col("rank") > F.col("below") + F.col("upto") - F.col("m")) & (F.col("rank") <= F.col("below") + F.col("upto")))
        inner = inner.select(*keys, "rank", F.col("x0").alias("lo"), F.col("x1").alias("hi"), F.col("m").alias("n"), (F.col("below") + F.col("upto") - F.col("m")).alias("below"))
        new = cut(inner.unionByName(state.where(~still)), "ranks")
        release(state)
        state = new
    small = (F.col("lo") < F.col("hi")) & (F.col("n") <= few)
    left = state.where(small).select(*keys, "lo", "hi").distinct()
    listed = held.join(left, keys).where(F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # ``few`` values at most
    found = state.where(small).join(listed, [*keys, "lo", "hi"]).select(*keys, "rank", F.element_at("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
    return found.unionByName(state.where(~small).select(*keys, "rank", F.col("lo").alias("x")))


def summary(values: DataFrame, keys: Sequence[str], shares: Mapping[str, float], **how) -> DataFrame:
    """keys, p50 (the median, halfway between the two in the middle), a column for each nearest-rank share, mean, most."""
    keys = list(keys)
    n = values.groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("most")).where("n > 0")
    at: dict[str, Column] = {name: F.greatest(F.lit(1.0), F.ceil(F.col("n") * q)).cast("long") for name, q in shares.items()}
    at |= {"_low": F.floor((F.col("n") + 1) / 2).cast("long"), "_high": F.ceil((F.col("n") + 1) / 2).cast("long")}
    asked = cut(n.select(*keys, "mean", "most", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.alias("rank")) for k, r in at.items()))).alias("a")).select(*keys, "mean", "most", "a.*"), "asked")
    found = asked.join(ranks(values, keys, asked, **how), [*keys, "rank"])
    pick = {name: F.max(F.when(F.col("name") == name, F.col("x"))) for name in at}
    out = found.groupBy(*keys).agg(*(c.alias(k) for k, c in pick.items()), F.max("mean").alias("mean"), F.max("most").alias("most"))
    return out.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("p50"), *shares, "mean", "most")
