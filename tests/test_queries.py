"""Every registered query against its SQL on the smallest data."""

import harness
import pytest

import __spark_entry__ as entry_point

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert harness.compare(spark, con, QUERIES[name], ORACLES.get(name), sf_dir) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0 and "materiality" in df.columns
