"""Every profile query with SQL gives the same rows as DuckDB; the others have rows."""

import pytest
from helpers import duck, rows_of

from vecfolio.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    found = QUERIES[name](spark, small).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        wanted = duck(small).execute(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
