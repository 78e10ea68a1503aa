"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, difference
from scoreloop.operators.metrics import error_summary_for
from scoreloop.plans.catalog import QUERIES
from scoreloop.plans.oracle import ORACLE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = ORACLE
@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_everything_is_registered():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan  # nothing leaves the JVM
    assert difference(df, con, SQL[name]) is None


def test_pushdown_and_pruning(spark):
    plan = queries()["drift_report"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz>" in plan  # the cutoff reads one column
    df = spark.read.parquet(f"{FOLDER}/customer.parquet").withColumnRenamed("c_name", "email")
    plan = error_summary_for(df, " ABC ", real="c_acctbal", pred="c_acctbal")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_name,abc)" in plan and "ReadSchema: struct<c_name:string,c_acctbal:double>" in plan


def test_entry(spark):
    assert entry(spark).count() == 1
