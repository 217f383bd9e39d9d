"""Every query of the catalog against the SQL it must agree with, on the smallest tables."""

from __future__ import annotations

import pytest

from rallyframe.plans import catalog

from .oracle import connection, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == sql_rows(con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert "badge" in found.columns and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
