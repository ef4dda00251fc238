"""Every query of the catalog against its SQL."""

from __future__ import annotations

import pytest

from factloom.plans import catalog

#: Queries that pick what few rows match; the small tables may hold none.
MAY_BE_EMPTY = {"agg5_object_conflicts", "jon7_value_conflicts", "jon9_checksum_dedup", "agg4_polarity_conflicts"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf_dir, same_rows):
    found = same_rows(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name])
    assert found or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
