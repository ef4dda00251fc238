"""Queries of this subpackage whose results SQL can give."""

import pytest

from factloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, same_rows):
    assert same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name])
