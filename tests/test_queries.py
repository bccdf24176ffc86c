from __future__ import annotations

import pytest
from compare import connect, differences

from servelens.plans.oracle import ORACLE
from servelens.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) is None


def test_queries_without_sql(spark, sf_dir):
    assert set(ORACLE) <= set(QUERIES)
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) <= set(e.queries())
