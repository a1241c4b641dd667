"""Registered queries against their DuckDB SQL, over whole tables."""

import pytest
from anonframe.llm.queries import ORACLE_SQL, QUERIES

from ..compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == oracle(sf, ORACLE_SQL[name])
