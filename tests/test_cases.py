"""The stated cases of every scalar operator, nulls and empty texts among them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rallyframe.plans.catalog import FACTS, ORACLE_SQL, QUERIES, split_ddl

from .oracle import plain


@pytest.mark.parametrize("name", sorted(FACTS))
def test_cases(spark, name):
    ddl, cases, f = FACTS[name]
    n = len(split_ddl(ddl))
    rows = spark.createDataFrame([(i, *c[:n]) for i, c in enumerate(cases)], f"k bigint, {ddl}")
    value = f(*(F.col(c.split()[0]) for c in split_ddl(ddl)))
    named = list(value.values()) if isinstance(value, dict) else [value]
    found = rows.select("k", *(c.alias(f"o{i}") for i, c in enumerate(named))).orderBy("k").collect()
    assert [tuple(map(plain, r[1:])) for r in found] == [tuple(map(plain, c[n:])) for c in cases]


def test_every_expression_has_its_query():
    assert set(FACTS) <= set(QUERIES) & set(ORACLE_SQL)
