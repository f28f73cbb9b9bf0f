"""The registered queries against their SQL."""

import pytest

from arrayloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_each(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
