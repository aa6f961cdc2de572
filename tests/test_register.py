"""Every registered query against its SQL on the small tables."""

import compare
import pytest

import __spark_entry__ as register

QUERIES, ORACLE = register.queries(), register.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return compare.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(register.LLM_QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), db, ORACLE[name]) is None


def test_entry(spark):
    assert register.entry(spark).limit(1).count() == 1
