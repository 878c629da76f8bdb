"""Every query against its SQL twin on the smallest tables; those without a twin must run."""

import os

import oracle
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: f for k, f in __spark_entry__.queries().items() if ".llm." not in f.__module__}
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.compare(df, ORACLES[name], con) == ""
    else:
        assert df.count() >= 0


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["table_name", "pk", "sk", "sequence_number"]
