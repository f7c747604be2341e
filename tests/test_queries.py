"""Every query with SQL gives the rows of its SQL."""

from __future__ import annotations

import pytest

import dialogmill.jobs.dialog_queries
import dialogmill.jobs.feature_queries  # noqa: F401
from dialogmill.jobs.registry import QUERIES, SQL
from tests.oracle import oracle_rows, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == oracle_rows(SQL[name], sf_dir)


def test_all_names_have_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
