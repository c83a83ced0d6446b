"""Every registered query against its SQL oracle, and the shape of the plans."""

import re

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents".split()
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}
from vitrina.workload.oracles import ORACLES  # noqa: E402
from vitrina.workload.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("NULL" if v is None else repr(v) for v in row) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    result = oracle.execute(ORACLES[name])
    kinds = {d[0]: TYPES[str(d[1])] for d in result.description}
    assert dict(df.dtypes) == kinds
    columns = sorted(kinds)
    place = [list(kinds).index(c) for c in columns]
    expected = canonical([r[i] for i in place] for r in result.fetchall())
    assert canonical(df.select(*columns).collect()) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


WITHOUT_JOBS = sorted(set(QUERIES) - {"roundtrip_parquet"})


# Records that lie over byte ranges are put together in file order, a task at a time, which no
# built-in operator expresses: these readers alone run Python.
BYTE_RANGES = {"ingest_csv", "dump_tuple_rows", "dump_tuple_tables"}


@pytest.mark.parametrize("name", WITHOUT_JOBS)
def test_plan_has_no_cross_join_or_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|PythonUDF|MapInArrow", plan)
    assert ("MapInPandas" in plan) == (name in BYTE_RANGES)


@pytest.mark.parametrize("name", ["rep_kpis", "shelf_kpis", "monthly_rollup", "geo_kpis"])
def test_large_sides_are_not_broadcast_beyond_the_threshold(spark, sf_dir, name):
    """With broadcasting switched off the plan must still work: nothing is forced."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, sf_dir)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_visit_facts_scan_only_what_they_need(spark, sf_dir):
    plan = QUERIES["daily_trend"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and all("value" not in s and "props" not in s for s in scans)
