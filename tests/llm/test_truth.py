from __future__ import annotations

import random

from pyspark.sql import functions as F

from strandwork.llm.addresses import repository
from strandwork.llm.truth import discover_truth, gathered, lineage_records, source_weights

CLAIMS = "entity string, f string, g string, h string, source string, recency int, record long, claims string"
RANKS = {"good": 1, "fair": 2, "poor": 3}


def run(spark, rows, ranks=None, least=1):
    """``rows`` are (entity, field, value, source, recency, record)."""
    wide = [(e, *[v if f == x else None for x in "fgh"], s, t, i, "clash") for e, f, v, s, t, i in rows]
    return discover_truth(gathered(spark.createDataFrame(wide, CLAIMS), ("f", "g", "h"), least), ranks)


def winners(spark, rows, ranks=None):
    return {(r["entity"], r["field"]): (r["value"], r["record"]) for r in run(spark, rows, ranks)[0].collect()}


def test_ranked_claims(spark):
    rows = [
        ("A", "f", "x", "poor", 9, 1), ("A", "f", "x", "fair", 9, 2), ("A", "f", "x", "unheard", 9, 20), ("A", "f", "y", "good", 1, 3),  # no number of worse votes wins
        ("A", "g", "x", "fair", 1, 4), ("A", "g", "y", "fair", 2, 5),  # later
        ("A", "h", "x", "fair", 2, 9), ("A", "h", "y", "fair", 2, 8),  # tie: smaller record
        ("B", "f", None, "good", 9, 10), ("B", "f", "z", "unheard", 1, 11), ("B", "f", "w", "poor", 0, 12), ("B", "g", "w", None, 0, 12), ("C", "g", "v", "unheard", None, 14),
        (None, "f", "x", "good", 1, 13),
    ]
    assert winners(spark, rows, RANKS) == {("A", "f"): ("y", 3), ("A", "g"): ("y", 5), ("A", "h"): ("y", 8), ("B", "f"): ("w", 12), ("C", "g"): ("v", 14)}
    # without the order the votes of the many decide
    assert winners(spark, rows)["A", "f"][0] == "x"


def test_ranked_claims_by_brute_force(spark):
    random.seed(2)
    rows = [(f"E{random.randint(0, 60)}", random.choice("fg"), random.choice("uvw"), random.choice([*RANKS]), random.randint(0, 3), i) for i in range(900)]
    rows += [("HOT", "f", "v", "poor", 0, 1000 + i) for i in range(450)]
    best: dict = {}
    for e, f, v, s, t, i in rows:
        key = (RANKS[s], -t, i)
        if (e, f) not in best or key < best[e, f][0]:
            best[e, f] = (key, (v, i))
    assert winners(spark, rows, RANKS) == {k: v for k, (_, v) in best.items()}


def simulated(sources, entities=200):
    random.seed(4)
    rows, record = [], 0
    for e in range(entities):
        for s, right in sources:
            record += 1
            rows.append((f"E{e}", "f", "true" if random.random() < right else f"false{random.randint(0, 1)}", s, 0, record))
    return rows


def test_votes_find_the_reliable_sources(spark):
    found, weights, rounds = run(spark, simulated((("a", 0.95), ("b", 0.9), ("c", 0.3), ("d", 0.3))))
    assert weights["a"] > weights["b"] > max(weights["c"], weights["d"]) and rounds > 2
    assert sum(r["value"] == "true" for r in found.collect()) >= 185


def test_the_order_is_a_prior_and_unlisted_sources_are_learnt(spark):
    rows = simulated((("good", 0.8), ("fair", 0.9), ("poor", 0.9), ("new", 0.95), ("odd", 0.2)))
    by_rank, weights, rounds = run(spark, rows, RANKS)
    assert rounds > 1 and weights["good"] > weights["fair"] + weights["poor"] + weights["new"] + weights["odd"] - 1e-9 and weights["new"] > weights["odd"]
    free = run(spark, rows)[0]
    assert {(r["entity"], r["value"]) for r in by_rank.collect()} != {(r["entity"], r["value"]) for r in free.collect()}


def test_weights():
    got = source_weights({"good": 0.4, "fair": 0.8, "poor": 0.6, "new": 0.9}, RANKS)
    assert got["good"] > got["fair"] + got["poor"] + got["new"] and got["fair"] > got["poor"] + got["new"] and got["poor"] > got["new"] > 0
    assert source_weights({"a": 0.5, "b": 1.0})["b"] > source_weights({"a": 0.5})["a"] > 0 and source_weights({}, RANKS) == {}


def test_empty(spark):
    assert run(spark, [], RANKS)[0].count() == 0 and run(spark, [])[0].count() == 0
    assert run(spark, [("A", "f", "x", "good", 1, 1)], RANKS, least=2)[0].count() == 0


def test_usable_claims(spark):
    columns = "record_id long, lineage_id string, record_source string, fetched_at_utc timestamp, source_repo string, first_observed_repo_date string, first_observed_offending_commit_date string, removal_or_disable_date string, value string, entity string"
    row = lambda i, lineage, repo, day: (i, lineage, "good", None, repo, day, "2007-12-31", "2027-01-01", "clash", "clash")
    df = spark.createDataFrame([row(1, " ukbl-1", "x/", "2020-02-30"), row(2, "UKBL-1 ", "https://www.h.example/A/b.git", "31 Dec 2026"), row(3, "UKBL-2", "a/b", "2020-01-01"), row(4, None, "a/b", None)], columns)
    records = lineage_records(df)
    assert records.count() == 3
    found = discover_truth(gathered(records, ("source_repo", "first_observed_repo_date", "removal_or_disable_date"), 2), RANKS)[0]
    got = sorted((r["entity"], r["field"], r["value"], r["record"]) for r in found.collect())
    assert got == [("UKBL-1", "first_observed_repo_date", "2026-12-31", 2), ("UKBL-1", "source_repo", "a/b", 2)]


def test_plain_days_read_as_by_the_cascade(spark):
    days = ["2020-02-29", "2021-02-29", " 2012/03/04 ", "2019-01-02T23:59:59Z", "2019-01-02 10:00:00", "2019-13-01", "03 Feb 2015", "2018-05-06T01:00:00+02:00", "", None]
    df = spark.createDataFrame([(i, "L", "good", None, "a/b", d, d, None) for i, d in enumerate(days)], "record_id long, lineage_id string, record_source string, fetched_at_utc timestamp, source_repo string, first_observed_repo_date string, first_observed_offending_commit_date string, removal_or_disable_date string")
    got = {r["record"]: r["first_observed_repo_date"] for r in lineage_records(df).collect()}
    assert [got[i] for i in range(len(days))] == ["2020-02-29", None, "2012-03-04", "2019-01-02", "2019-01-02", None, "2015-02-03", "2018-05-05", None, None]


def test_addresses(spark):
    same = ["https://codehost.example/Own/Name.git", "http://www.codehost.example/own/name/", "git@codehost.example:own/name.git", "codehost.example/own/name", " own / name ", "https://raw.codehost.example/own/name/main/a/b.csv", "https://codehost.example/own/name/blob/dev/x?plain=1#L2", "ssh://git@codehost.example/own/name", "OWN/NAME"]
    none = ["own/", "/name", "unknown", "N/A", "", "  ", None, "404", "see notice", "https://codehost.example/own", "a." * 100_000, "own/" * 0 + "x" * 200_000, "@" * 100_000]
    df = spark.createDataFrame([(t,) for t in same + none], "t string").select(repository(F.col("t")))
    assert [r[0] for r in df.collect()] == ["own/name"] * len(same) + [None] * len(none)
