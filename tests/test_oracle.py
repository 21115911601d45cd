"""Every query with SQL gives the same rows on both engines."""

import pytest
from oracle import connect, rows

from quarrylens.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, sf, db, name):
    ours = catalogue.QUERIES[name](spark, sf).toPandas()
    theirs = db.execute(catalogue.SQL[name]).df()
    assert rows(ours) == rows(theirs)


#: Queries that may find nothing in the smallest tables.
SPARSE = {"tramp_groups", "code_clones", "code_hotspots"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_queries_without_sql_run(spark, sf, name):
    """They have value tests of their own; here every row and column is computed on real tables."""
    found = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(found.columns) and (len(found) or name in SPARSE)


def test_sql_only_for_known_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
