"""Series, panels and follow-up reach the last order. The SQL beside these queries ends earlier; here its last periods and days are those of the data."""

from __future__ import annotations

import pytest

from comparison import rows
from strandwork.plans import catalogue

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
SQL = {n: s for m in catalogue.modules() for n, s in m.ORACLE_SQL.items()}


def last(unit: str) -> str:
    return f"(SELECT max(date_trunc('{unit}', o_orderdate))::DATE FROM orders)"


def same_but_for_the_end(spark, folder, duck, name: str, literal: str, end: str) -> None:
    assert f"DATE '{literal}'" in SQL[name]
    got, expected = QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name].replace(f"DATE '{literal}'", end)).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize(("name", "unit", "literal"), [("monthly_counts", "month", "1999-03-01"), ("quarterly_counts", "quarter", "1999-01-01"), ("weekly_counts", "week", "1999-01-04"), ("daily_counts", "day", "1999-01-31")])
def test_series_hold_every_order(spark, folder, duck, name, unit, literal):
    same_but_for_the_end(spark, folder, duck, name, literal, last(unit))
    got = QUERIES[name](spark, folder).toPandas()
    assert (got["urgent"].sum(), got["low"].sum()) == duck.execute("SELECT count(*) FILTER (o_orderpriority = '1-URGENT'), count(*) FILTER (o_orderpriority = '5-LOW') FROM orders").fetchone()


@pytest.mark.parametrize("name", ["risk_panel_quarter", "age_bins", "event_time_means", "eligible_both_sides"])
def test_panels_hold_every_order(spark, folder, duck, name):
    same_but_for_the_end(spark, folder, duck, name, "1998-10-01", last("quarter"))
    got, (orders, customers) = QUERIES[name](spark, folder).toPandas(), duck.execute("SELECT count(*), count(DISTINCT o_custkey) FROM orders").fetchone()
    if name == "risk_panel_quarter":
        assert (got["n"].sum(), got["o_custkey"].nunique()) == (orders, customers)
    if name == "age_bins":
        assert got["events"].sum() == orders


@pytest.mark.parametrize("name", ["poisson_qmle", "fe_did_cluster"])
def test_fits_see_the_whole_panel(spark, folder, duck, name):
    panel = duck.execute(SQL["risk_panel_quarter"].replace("DATE '1998-10-01'", last("quarter"))).df()
    seen = len(panel) if name == "poisson_qmle" else (panel["period_start"].astype(str) >= "1995-01-01").sum()
    assert set(QUERIES[name](spark, folder).toPandas()["n_obs"]) == {seen}


@pytest.mark.parametrize(("name", "unit", "literal", "column"), [("point_in_time_denominator", "month", "1998-12-01", "started"), ("cohort_rates", "quarter", "1998-10-01", "n")])
def test_every_customer_has_started(spark, folder, duck, name, unit, literal, column):
    same_but_for_the_end(spark, folder, duck, name, literal, last(unit))
    got, (customers,) = QUERIES[name](spark, folder).toPandas(), duck.execute("SELECT count(DISTINCT o_custkey) FROM orders").fetchone()
    assert (got[column].max() if column == "started" else got[column].sum()) == customers


@pytest.mark.parametrize(("name", "literal"), [("fixed_followup", "1998-08-02"), ("km_curve", "1998-12-31")])
def test_follow_up_ends_with_the_last_order(spark, folder, duck, name, literal):
    same_but_for_the_end(spark, folder, duck, name, literal, "(SELECT max(o_orderdate)::DATE FROM orders)")


def test_no_time_is_negative_and_orders_set_the_censoring_day(spark, tmp_path):
    days = [(1, "1999-03-01"), (1, "1999-04-01"), (2, "1999-06-01"), (3, "2000-03-01")]
    spark.createDataFrame(days, "o_custkey int, d string").selectExpr("o_custkey", "d::timestamp AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    assert [tuple(r)[:3] for r in QUERIES["km_curve"](spark, str(tmp_path)).orderBy("t").collect()] == [(0, 3, 0), (31, 2, 1), (274, 1, 0)]
    assert {r["months"]: (r["eligible"], r["inclusive"]) for r in QUERIES["fixed_followup"](spark, str(tmp_path)).collect()} == {6: (2, 1), 12: (1, 1), 24: (0, 0)}
