from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.functions.structured import find_keys
from strandwork.models import stats as S
from strandwork.operators import relational as R
from strandwork.plans.crosswalks import panel_sample, publication_legs


def test_phrases_meet_texts_by_their_rarest_word(spark):
    texts = spark.createDataFrame([(1, "The HEART-failure clinic", 7), (2, "heart and failure", 7), (3, None, 7), (4, "", 7), (1, "The HEART-failure clinic", 7), (5, "heart " * 20_000 + "failure", 7)], "id int, t string, phrase int")
    phrases = spark.createDataFrame([("Heart failure",), ("heart, failure!",), ("clinic",), ("unheard of",), (None,), ("",), ("...",)], "phrase string")
    got = sorted(tuple(r) for r in R.phrase_join(texts, "t", phrases, "phrase").collect())
    assert got == [(1, "clinic")] * 2 + [(1, "heart failure")] * 2 + [(5, "heart failure")]
    assert R.phrase_join(texts.limit(0), "t", phrases, "phrase").count() == R.phrase_join(texts, "t", phrases.limit(0), "phrase").count() == 0


def _shuffled(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_phrase_join_shuffles_no_texts(spark):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(rng.integers(10**9, 10**10, 400).astype(str))) for i in range(40)]
    # each of these words is in one text, so that every one of them opens a phrase
    asked = [(w,) for _, t in texts for w in t.split()[::2]]
    df, phrases = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(asked, "phrase string")
    before = _shuffled(spark)
    assert R.phrase_join(df, "t", phrases, "phrase").count() == len(asked)
    # a copy of its text beside each word came to 130 times that; a phrase is shuffled as asked, as found and in its checksums
    assert _shuffled(spark) - before < 10 * sum(len(w) for (w,) in asked)


def test_phrase_join_as_brute_force(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(rng.choice(list("abc"), n))
    texts = [(i, i % 3 or None, words(int(rng.integers(1, 60)))) for i in range(120)] + [(0, None, None), (1, 1, " - ")]
    phrases = sorted({words(int(n)) for n in rng.integers(1, 11, 200)} | {t for _, _, t in texts[:20]} | {"a" + " b" * 40})
    got = R.phrase_join(spark.createDataFrame([*texts, *texts[:2]], "id int, g int, t string").repartition(5), "t", spark.createDataFrame([(p,) for p in phrases], "p string"), "p").collect()
    want = [(i, g, p) for i, g, t in [*texts, *texts[:2]] for p in phrases if t and f" {p} " in f" {t} "]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 1_000


def test_split_keeps_its_contract(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string")
    first, second = R.split_with_contract(df, F.col("s") == "a", working=1, audit=2)
    assert (first.count(), second.count()) == (1, 2)
    with pytest.raises(ValueError, match="working has 1 rows instead of 2"):
        R.split_with_contract(df, F.col("s") == "a", working=2, audit=1)


def test_legs_of_publications(spark):
    pubs = spark.createDataFrame([("1", "10.5555/Ab.1", "900000001", "A title that is long enough"), ("02", None, "", "short"), ("1", "10.5555/ab.1", "900000001", "A title that is long enough"), ("x", "10.5555/q", None, None)], "pub_id string, doi string, pubmed_id string, title string")
    rows = [(1, "doi:10.5555/AB.1; 10.5555/zz", None, None), (2, None, "900000001, 900000009", None), (3, None, None, "A TITLE that is -- long enough"), (4, None, None, "short"), (5, "10.5555/q", None, None), (6, None, None, None)]
    repos = spark.createDataFrame(rows, "repo_row_id int, doi string, pubmed_id string, paper_title string")
    assert sorted(tuple(r) for r in publication_legs(repos, pubs).collect()) == [(1, "doi", 1), (2, "pmid", 1), (3, "title", 1)]


def test_samples_have_names(spark):
    with pytest.raises(ValueError, match="no sample"):
        panel_sample(spark.range(1), "nope")
    assert panel_sample(spark.range(3), "all").count() == 3


def test_fixed_text_and_reals(spark):
    df = spark.createDataFrame([(1.0, " 2.50 "), (float("nan"), "1e3"), (None, "nan"), (-0.126, ".5"), (2.0, None)], "v double, t string")
    got = [tuple(r) for r in df.select(T.fixed(F.col("v"), 2), T.real_or_null(F.col("t"))).collect()]
    assert got == [("1.00", 2.5), (None, None), (None, None), ("-0.13", 0.5), ("2.00", None)]


def test_letters_of_two_sounds(spark):
    df = spark.createDataFrame([("Weiß Æsir Œuvre Þór Guðrún",)], "t string")
    assert df.select(T.ascii_plain(F.col("t"))).first()[0] == "weiss aesir oeuvre thor gudrun"


def test_all_keys_are_found(spark):
    many = "{" + ",".join(f'"a{i}": {{"k": {i}}}' for i in range(120)) + "}"
    df = spark.createDataFrame([(many,)], "j string")
    assert len(find_keys(df, "j", ("k",)).first()["found"]) == 120 and len(find_keys(df, "j", ("k",), limit=5).first()["found"]) == 5


def test_chi_squared_against_its_density():
    for df in (1, 2, 3, 8, 9):
        step = 1e-3
        area = sum(math.exp((df / 2 - 1) * math.log(x) - x / 2 - math.lgamma(df / 2) - df / 2 * math.log(2)) * step for x in (3 + (i + 0.5) * step for i in range(60_000)))
        assert math.isclose(S.chi2_tail(3, df), area, rel_tol=1e-5)
    assert S.chi2_tail(0, 4) == S.chi2_tail(-1, 3) == 1.0
    assert S.two_proportions(5, 10, 5, 10) == (0.0, 1.0) and math.isnan(S.two_proportions(0, 0, 1, 2)[0])
