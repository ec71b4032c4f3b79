"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
#: Tables that hold more roles than one page.
LARGER = "/root/testdata/sf0.01"
PAGED = ("shortlist", "shortlist_visible", "stage_counts", "filtered_shortlist", "shortlist_sources", "export_rows", "health_report")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_sql(spark, duck, name):
    problem, rows, *_ = compare(spark, duck, FOLDER, name)
    assert problem is None, problem
    assert rows > 0


@pytest.mark.parametrize("name", PAGED)
def test_more_roles_than_a_page(spark, name):
    problem, rows, *_ = compare(spark, connect(LARGER), LARGER, name)
    assert problem is None, problem
    assert rows > 0


def test_entry_and_registry(spark):
    assert entry(spark).limit(1).count() == 1
    assert set(oracle_sql()) <= set(queries())
