"""Every query with SQL gives what DuckDB gives; every other runs."""

import pytest
from compare import oracle, rows

from gridmason.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    got, expected = catalog.QUERIES[name](spark, data).toPandas(), oracle(catalog.ORACLE_SQL[name], data)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["color_clusters", "merged_trails", "synthetic_plan", "page_plan"])
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
