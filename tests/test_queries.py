"""Every registered query against its SQL, and the shape of the entry points."""

import __spark_entry__ as entry_points
import pytest
from compare import compare, connect

from sheetlens.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    faults = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    # a report may be empty on the smallest data
    assert [f for f in faults if f != "EMPTY RESULT"] == []


def test_entry_points(spark):
    rows = entry_points.entry(spark).collect()
    assert len(rows) == 7
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
