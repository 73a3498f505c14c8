"""Every query with SQL gives what DuckDB gives for it, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from kerbline.plans import ORACLES, QUERIES, fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    cols = [x[0] for x in result.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=key) == sorted([tuple(map(plain, r)) for r in result.fetchall()], key=key)


def test_rewritten_joins_stay_equi_joins(spark):
    for name in ("j7_adjacency", "j9_incident_distance_join", "s9_run_delta"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_segments_are_dealt_to_all_cores(spark):
    """The table of customers is one row group, which one task reads; what is derived of it takes long a row."""
    tasks = fixtures.road_segments(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism > 1
