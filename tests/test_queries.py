"""Every core query against its SQL, or at least made once."""

from __future__ import annotations

import pytest

from comparison import rows
from strandwork.plans import catalogue

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.ORACLE_SQL.items()}
SLOW = {"fe_did_cluster", "event_study"}  # their estimator has tests of its own


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, duck, name):
    got, expected = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, folder, name):
    assert len(QUERIES[name](spark, folder).toPandas().columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
