"""Every query with SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry_points
from workload.compare import connect, differences
from workload.oracles import oracle_sql as workload_oracles
from workload.oracles import _r as workload_rounding
from workload.queries import comparable as workload_comparable
from workload.queries import queries as workload_queries

from conftest import DATA

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(DATA)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(workload_queries()) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(workload_oracles()))
def test_query(spark, connection, name):
    assert differences(QUERIES[name](spark, DATA), connection, ORACLES[name]) == []


def test_entry(spark):
    result = entry_points.entry(spark)
    spent = {r["campaign_id"]: r["Spend"] for r in
             result.groupBy("campaign_id").agg({"Spend": "sum"})
             .withColumnRenamed("sum(Spend)", "Spend").collect()}
    assert len(spent) == 3
    assert all(abs(total - 1000.0) < 1e-2 for total in spent.values())


@pytest.mark.parametrize("value", [1e13, 1e16, -1e13, 0.1234565, -0.4e-7])
def test_rounding_clamps_nothing(spark, connection, value):
    rounded = workload_comparable(spark.createDataFrame([(value,)], "x double")).first()[0]
    expected = connection.execute(f"SELECT {workload_rounding(repr(value) + '::DOUBLE', 'x')}").fetchone()[0]
    assert repr(rounded) == repr(expected) and abs(rounded - value) <= 1e-6 + abs(value) * 1e-15
