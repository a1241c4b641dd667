import pytest
from anonframe.oracle import ORACLE_SQL
from anonframe.queries import QUERIES

from .compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = spark_rows(QUERIES[name](spark, sf))
    if name in ORACLE_SQL:
        assert got == oracle(sf, ORACLE_SQL[name])
    else:
        assert got[1]
