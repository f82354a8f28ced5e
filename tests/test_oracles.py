"""Every registered query against its SQL, with a look at its plan."""

import re

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences, sf_dir

FOLDER = sf_dir("0.001")
# Those of the training-data operators are in tests/llm.
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def duck():
    con = connect(FOLDER)
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, duck, sql) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "source", "score"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
