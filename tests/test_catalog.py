"""Every query of the catalogue against DuckDB on the smallest driver tables."""

import pytest

from millrace.plans import all_queries
from tests.compare import engine, rows

QUERIES, SQL = all_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    got, want = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(engine(sf_dir).sql(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
