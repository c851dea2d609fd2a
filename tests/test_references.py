from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators.references import apply_deltas, existence_deltas, key_balance, orphan_references, standing_orphans, whole_number

REFS = "target string, key bigint, row int, extra string"


def targets(spark, rows):
    df = spark.createDataFrame(rows, "k string, deleted_at string, key string")
    return existence_deltas(df, "t", whole_number(F.col("k")), F.col("deleted_at"))


def test_keys(spark):
    texts = [("0123",), (" 123 ",), ("123.0",), ("12.5",), ("x1",), ("",), (None,), ("-7",), ("9" * 30,)]
    got = [r[0] for r in spark.createDataFrame(texts, "k string").select(whole_number(F.col("k"))).collect()]
    assert got == [123, 123, 123, None, None, None, None, -7, None]


def test_orphans(spark):
    held = targets(spark, [("1", None, "a"), ("2", "gone", "a"), ("02", "gone", "a"), ("3", "gone", "a"), ("3.0", None, "a"), (None, None, "a"), ("x", None, "a")])
    refs = spark.createDataFrame([("t", 1, 1, "a"), ("t", 2, 2, "a"), ("t", 2, 2, "a"), ("t", 4, 3, None), ("t", None, 4, "a"), ("u", 1, 5, "a"), ("t", 3, 6, "a")], REFS)
    got = sorted((r["target"], r["key"], r["row"]) for r in orphan_references(refs, held).collect())
    assert got == [("t", 2, 2), ("t", 2, 2), ("t", 4, 3), ("u", 1, 5)]


def test_hot_key_and_empty_tables(spark):
    refs = spark.range(30_000).select(F.lit("t").alias("target"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("key"), F.col("id").cast("int").alias("row"), F.lit("e").alias("extra"))
    assert orphan_references(refs, targets(spark, [("7", None, "a")])).count() == 20_000
    assert orphan_references(refs.limit(0), targets(spark, [("7", None, "a")])).count() == 0
    assert orphan_references(refs, targets(spark, []).limit(0)).count() == 30_000


def test_deltas_add_up(spark):
    refs = spark.createDataFrame([("t", 1, 1, "a"), ("t", 2, 2, "a")], REFS)
    day1 = key_balance(refs, targets(spark, [("1", None, "a")]))
    day2 = apply_deltas(day1, targets(spark, [("2", None, "a")]))
    assert {r["key"]: (r["existing"], r["referring"]) for r in day2.collect()} == {1: (1, 1), 2: (1, 1)}


def test_standing_orphans_are_what_folded_deltas_say(spark):
    import random

    random.seed(5)
    rows = [(random.choice("ab"), random.choice([None, 1, 2, 3, 4]), random.choice([None, "2020-01", "2020-02", "2020-04"]), *random.choice([(1, 0), (-1, 0), (0, 1), (0, -1)])) for _ in range(120)]
    deltas = spark.createDataFrame(rows, "target string, key bigint, period string, existing bigint, referring bigint")
    got = {(r["target"], r["period"]): r["orphan_keys"] for r in standing_orphans(deltas).collect()}
    balance = deltas.select("target", "key", "existing", "referring").limit(0)
    for period in ("", "2020-01", "2020-02", "2020-04"):  # a batch a period
        batch = deltas.filter(F.col("key").isNotNull() & (F.coalesce("period", F.lit("")) == period)).select("target", "key", "existing", "referring")
        balance = spark.createDataFrame(apply_deltas(balance, batch).collect(), balance.schema)
        for t in "ab":
            if (t, period) in got:
                assert got[t, period] == balance.filter((F.col("target") == t) & (F.col("referring") > 0) & (F.col("existing") <= 0)).count()
    assert standing_orphans(deltas.limit(0)).count() == 0
