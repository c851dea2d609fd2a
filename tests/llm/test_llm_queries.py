"""Queries of the subpackage against SQL, and that nothing outside imports it."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from comparison import rows
from strandwork.llm import catalogue

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, duck, name):
    got, expected = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert len(got.columns) and (not name.endswith("_found") or not got.duplicated().any())


def test_nothing_else_imports_the_subpackage():
    package = Path(__file__).resolve().parents[2] / "strandwork"
    for file in package.rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"strandwork\.llm|from \.+llm", file.read_text()), file
