"""What the planner makes of the queries."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from strandwork.functions.structured import find_keys, merge_maps, paper_clues
from strandwork.functions.text import near, rule_hits
from strandwork.plans import catalogue
from strandwork.sources.files import replay_responses

QUERIES = {n: q for m in catalogue.modules() for n, q in m.QUERIES.items()}
EAGER = {"fe_did_cluster", "event_study", "poisson_qmle", "logit_newton", "ols_robust"}  # their results are local rows
#: joins to one row that holds a threshold, a size or a rate
ONE_ROW = {"top_one_percent", "fixed_cohort_intensity", "pipeline_expected"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_products_and_no_row_wise_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert name in ONE_ROW or "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "columns"), [("monthly_counts", {"o_orderdate", "o_orderpriority"}), ("p7_found", {"repo_row_id", "earliest_observed_offending_file_commit_date", "commit_zone", "wayback_first_capture"}), ("rule_match", {"doc_id", "text"})])
def test_scans_read_only_what_is_asked_for(spark, folder, name, columns):
    schemas = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, folder)))]
    assert columns in schemas


def test_filters_reach_the_scan(spark, folder):
    assert re.search(r"PushedFilters: \[[^\]]*o_orderpriority", plan(QUERIES["semi_members"](spark, folder)))


def test_rules_clues_and_maps(spark):
    df = spark.createDataFrame([("a 12 b 7 cohort x platform", '{"A-b": 1, "c": {"ab": "x", "l": [{"AB": null}, {"a_b": 2}]}}'), (None, "{broken"), ("", None)], "t string, j string")
    got = [[(h["rule"], h["position"], h["hit"]) for h in r[0]] if r[0] else [] for r in df.select(rule_hits(F.col("t"), [("word", "platform"), ("n", "[0-9]+"), ("no", "zzz")])).collect()]
    assert got == [[("word", 19, "platform"), ("n", 3, "12")], [], []]
    assert [r[0] for r in df.select(near(F.col("t"), "cohort", "platform", 5), ).collect()] == [True, None, False]
    assert [r["found"] for r in find_keys(df, "j", ("ab",)).collect()] == [["1", "x", "2"], [], []]
    cff = spark.createDataFrame([('cff-version: 1.2\ntitle: "A study"\nAuthors: X and Y\ndoi: 10.1/x\n',)], "t string")
    assert cff.select(paper_clues(F.col("t"))).first()[0] == {"title": "A study", "doi": "10.1/x", "authors": "X and Y"}
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "", "c": "3"}), (None, {"x": "1"})], "a map<string,string>, b map<string,string>")
    assert [r[0] for r in m.select(merge_maps(F.col("a"), F.col("b"))).collect()] == [{"a": "1", "b": "", "c": "3"}, {"x": "1"}]


def test_replayed_responses(spark):
    requests = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "url string, n int")
    cache = spark.createDataFrame([("u1", 200, "old", 1), ("u1", 404, "new", 2), ("u2", 0, "down", 5)], "url string, status int, body string, fetched_at int")
    assert [tuple(r)[1:4] for r in replay_responses(requests, cache).orderBy("n").collect()] == [(1, 404, "new"), (2, None, None), (3, None, None)]
