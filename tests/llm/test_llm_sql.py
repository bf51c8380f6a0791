"""The queries that SQL can express give the SQL's rows."""

import pytest
from compare import connect, same

from wayfold.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
