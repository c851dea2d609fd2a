from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.operators import calendar as C
from strandwork.operators import relational as R
from strandwork.operators.ordered import exact_quantiles, holm, top_k
from strandwork.streaming.windows import first_seen, stream_of, windowed


def test_dedupe_and_lookup(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "n")], "k int, o int, v string")
    assert sorted((r["k"], r["v"]) for r in R.dedupe(df, ["k"], ["o"], "last").filter("k is not null").collect()) == [(1, "b"), (2, None)]
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    assert sorted((str(r["k"]), r["v"]) for r in R.lookup(left, df, "k", ["o"]).collect()) == [("1", "b"), ("3", None), ("None", None)]


def test_exact_quantiles_as_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.exponential(10, 5001), 1)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)] + [(0, None)], "g int, v double").repartition(7)
    got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "v", [0, 0.1, 0.5, 0.99, 1], ["g"]).collect()}
    for (g, q), v in got.items():
        assert np.isclose(v, np.quantile(values[np.arange(5001) % 3 == g], q))
    assert len(got) == 15 and exact_quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_top_k_plan_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), "id")
    top = top_k(df, ["g"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 10


def test_holm(spark):
    df = spark.createDataFrame([(1, "a", 0.01), (2, "a", 0.04), (3, "a", 0.03), (1, "b", 0.9)], "t int, f string, p double")
    assert {(r["f"], r["t"]): round(r["holm_p"], 6) for r in holm(df, ["f"], "p", "t").collect()} == {("a", 1): 0.03, ("a", 3): 0.06, ("a", 2): 0.06, ("b", 1): 0.9}


def test_overlay_and_first_rule(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in R.overlay(base, changes, ["k"]).collect()) == [(1, "a", False), (2, "x", True), (3, "y", True)]
    rules = [("second", F.col("v") == "b"), ("any", F.col("v").isNotNull())]
    assert {r["k"]: r["name"] for r in R.first_rule(base, "k", rules).collect()} == {1: "any", 2: "second"}
    assert R.reconcile(base, changes, ["k"]).first().asDict() == {"matched": 1, "missing": 1, "extra": 1, "status": "FAIL"}
    with pytest.raises(ValueError):
        R.phrases_in(base, "v", ["x"] * 6000)


def test_month_arithmetic(spark):
    rows = spark.createDataFrame([("2024-01-31", "2024-02-29"), ("2023-02-28", "2024-02-27"), ("2024-05-15", "2024-05-15")], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = rows.select(C.completed_months(F.col("a"), F.col("b")), C.calendar_months(F.col("a"), F.col("b")), C.label(F.col("a"), "week")).collect()
    assert [tuple(r) for r in got] == [(0, 1, "2024-W05"), (11, 12, "2023-W09"), (0, 0, "2024-W20")]
    texts = spark.createDataFrame([("2024-02-30",), ("2024",), (" 2024-01-02 ",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in texts.select(C.lenient_date(F.col("t"))).collect()] == ["None", "2024-01-01", "2024-01-02", "None", "None"]


def test_panel_censoring(spark):
    e = spark.createDataFrame([(1, "2024-02-10", "2024-05-01"), (2, "2025-01-01", None)], "id int, s string, c string").select("id", F.to_date("s").alias("s"), F.to_date("c").alias("c"))
    got = C.at_risk_panel(e, "id", "s", [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30"), ("2024-07-01", "2024-09-30")], "c").orderBy("period_start").collect()
    assert [(r["id"], r["at_risk_days"], r["first_partial"]) for r in got] == [(1, 51, True), (1, 31, False)]


def test_text_functions(spark):
    df = spark.createDataFrame([("The camelCase sleepModel for <b>U&amp;I</b> 10.1234/ab.c;", "Jo Bloggs")], "t string, p string")
    r = df.select(
        T.tokens(F.col("t")).alias("tokens"), T.strip_markup(F.col("t")).alias("plain"), T.identifiers(F.col("t"), "doi").alias("doi"),
        T.name_in_tokens(F.col("p"), F.array(F.lit("j"), F.lit("bloggs"))).alias("named"), T.snippet(F.col("t"), F.lit(5), 5, 3).alias("cut"),
    ).first()
    assert r["tokens"][:3] == ["camel", "case", "sleep"] and r["plain"].startswith("The camelCase sleepModel for U&I") and r["doi"] == ["10.1234/ab.c"]
    assert r["named"] and r["cut"] == "...he camelCas..."


def test_stream_gives_what_the_batch_gives(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "event_type", "value")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    query = windowed(first_seen(stream_of(spark, str(tmp_path / "in"), 3)), late=None).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((str(r["window_start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("w")) == key(windowed(events))


def test_best_pairs_hold_the_best_of_each_row(spark):
    import random

    from strandwork.operators import linkage as K

    random.seed(3)
    value = lambda n: random.choice([None, "", *(["hot"] * 3), *(f"v{i}" for i in range(n))])
    left = [(i, value(4), value(3), value(5)) for i in range(60)]
    right = [(i, value(4), value(3), value(5)) for i in range(150)]
    points = (35, 15, 20)
    expected = set()
    for i, *a in left:
        scored = sorted((-sum(p for p, x, y in zip(points, a, b) if x and x == y), str(j), j) for j, *b in right if (a[0] and a[0] == b[0]) or (a[2] and a[2] == b[2]))
        expected |= {(i, j, -s) for s, _, j in scored[:5]}
    frame = lambda rows, i: spark.createDataFrame(rows, f"{i} int, t string, n string, p string")
    pairs = K.best_pairs(frame(left, "a"), frame(right, "b"), "a", "b", ["t", "n", "p"], ["t", "p"], 5)
    both = pairs.join(frame(left, "a"), "a").join(frame(right, "b").toDF("b", "t2", "n2", "p2"), "b")
    components = [K.Component(c, F.when((F.col(c) == F.col(f"{c}2")) & (F.col(c) != ""), float(w))) for c, w in zip("tnp", points)]
    best = K.rank_and_grade(K.score_pairs(both, components), "a", "b", 5)
    assert {(r["a"], r["b"], int(r["score"])) for r in best.collect()} == expected
    assert pairs.count() <= 60 * 5 * 6
    assert K.infer_columns(["App ID", "projectTitle", "notes"], {"id": ("app id",), "title": ("title",), "when": ("date",)}) == {"id": "App ID", "title": "projectTitle", "when": None}
