from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm.phrases import title_keys, title_phrases, words
from strandwork.llm.synonyms import learn_links
from strandwork.llm.topics import fit_logistic, match_subject_and_people, subjects

CAUSES = {f"bravo{i}ka": f"{'mistro' if i % 2 else 'pelnu'}{i}fen tork{i}" for i in range(24)}
ENDS = {f"zundal{i}": f"olvek{i} grast{i}" for i in range(24)}
WAYS = ["by ship logs", "with paper maps", "from old bells", "near salt pans"]


def corpus(seed=3, people=400, each=5):
    """Titles in invented words: a person's papers treat the person's applications (in other words) or anything else."""
    rng = random.Random(seed)
    apps, papers, true = [], [], set()
    for p in range(people):
        own = [(rng.choice([*CAUSES]), rng.choice([*ENDS])) for _ in range(3)]
        for k, (c, e) in enumerate(own):
            apps.append((p * 10 + k, p, f"Probing {c} against {e} {rng.choice(WAYS)}"))
        for k in range(each):
            c, e = rng.choice(own) if k < 3 else (rng.choice([*CAUSES]), rng.choice([*ENDS]))
            true |= {(p * 10 + k, p * 10 + j) for j, x in enumerate(own) if x == (c, e)}
            said = rng.choice([c, CAUSES[c]]), rng.choice([e, ENDS[e]])
            papers.append((p * 10 + k, p, f"How {said[0]} drives {said[1]}, {rng.choice(WAYS)}"))
    return apps, papers, true


def sides(spark, apps, papers):
    frames = []
    for rows in (papers, apps):
        df = spark.createDataFrame([(*r, "x") for r in rows], "id long, person long, title string, key string")
        frames += [df.select("id", "person").distinct(), title_keys(df, "id", "title")]
    return frames


def test_words_and_keys(spark):
    assert words("Lp(a) & Parkinson's ÉTÉ") == ["lp", "a", "parkinsons", "ete"]
    df = spark.createDataFrame([(1, "A b"), (1, "a B!"), (2, None), (3, ""), (4, "??"), (None, "x")], "id long, title string")
    assert [tuple(r) for r in title_keys(df, "id", "title").collect()] == [(1, "a b")]
    assert title_phrases(title_keys(df.limit(0), "id", "title")).count() == 0


def test_phrases_are_glued_by_counts_and_slips_are_read(spark):
    rng = random.Random(1)
    heads = [f"red{i} moon{i}" for i in range(30)]
    titles = {f"{rng.choice('pqrst')}{rng.randint(0, 400)} of {rng.choice(heads)} w{rng.randint(0, 300)}" for _ in range(1500)} | {"a1 of red7 mooon7 w1"}
    found = title_phrases(spark.createDataFrame([(t,) for t in titles], "key string"))
    phrases = {r[0] for r in found.select("phrase").distinct().collect()}
    assert set(heads) <= phrases and "of" not in phrases
    assert found.filter(F.col("key") == "a1 of red7 mooon7 w1").filter("phrase = 'red7 moon7'").count() in (0, 1)


def test_subjects_are_learnt_without_a_list(spark):
    apps, papers, true = corpus()
    who, keys, lead, titles = sides(spark, apps, papers)
    phrases = title_phrases(keys.select("key").union(titles.select("key")))
    asked, held = (a.join(k, "id").select("person", "key").distinct().join(phrases, "key") for a, k in ((who, keys), (lead, titles)))
    links = {r["c"]: r["d"] for r in learn_links(asked, held).collect()}
    wanted = CAUSES | ENDS
    right = sum(links.get(said) == meant for meant, said in wanted.items())
    assert right >= 45, links
    assert not any(w.split(" ", 1)[1] in c for c in links for w in WAYS)


def test_pairs_outside_any_list_are_matched(spark):
    apps, papers, true = corpus()
    queries, documents = subjects(*sides(spark, apps, papers))
    found = {(r["query"], r["document"]) for r in match_subject_and_people(queries, documents).collect()}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.95 * len(found)


ROW = "id long, person long, names array<string>, score int"


def match(spark, queries, documents, **k):
    q, d = (spark.createDataFrame([(*r, 0) for r in rows], ROW) for rows in (queries, documents))
    return {(r["query"], r["document"]): r["confidence"] for r in match_subject_and_people(q, d, **k).collect()}


def many(n=60):
    """Leads with two applications each, and one asking row for the first of them."""
    documents = [(p * 10 + k, p, sorted((f"a{(p + k * 7) % 11}", f"b{(p * 3 + k) % 13}"))) for p in range(n) for k in (0, 1)]
    queries = [(p, p, sorted((f"a{p % 11}", f"b{p * 3 % 13}"))) for p in range(n)]
    return queries, documents


def test_nearest_pairs(spark):
    queries, documents = many()
    expected = {(q, d) for q, p, s in queries for d, o, t in documents if p == o and s == t}
    got = match(spark, queries + queries[:3], documents + documents[:5])
    assert set(got) == expected and all(0.5 <= v <= 1 for v in got.values())
    # a term less on the asking side: nothing is sure any more, so the terms are more than a filter
    assert not set(match(spark, [(q, p, s[:1]) for q, p, s in queries], documents)) & expected
    extra = [(900, 3, ["a3", "zz"]), (901, None, ["a1", "b1"]), (902, 4, None), (903, 4, [])]
    assert set(match(spark, queries + extra, documents)) == expected


def test_a_hot_lead_makes_no_more_pairs_than_matches(spark):
    documents = [(i, 1, [f"a{i % 40}", f"b{i % 37}"]) for i in range(1480)]
    queries, others = many()
    hot = match(spark, [(i, 1, [f"a{i % 40}", f"b{i % 37}"]) for i in range(1480)] + [(5000 + q, p + 10, s) for q, p, s in queries], documents + [(5000 + d, p + 10, s) for d, p, s in others])
    assert {(q, d) for q, d in hot if q < 1480} == {(i, i) for i in range(1480)}


def test_empty(spark):
    queries, documents = many(4)
    assert match(spark, [], documents) == {} and match(spark, queries, []) == {}


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = fit_logistic(x, y)
    assert abs(a + 1) < 0.15 and abs(b - 2) < 0.2 and list(fit_logistic(np.zeros((0, 1)), np.zeros(0))) == [0, 0]
    with pytest.raises(RuntimeError):
        fit_logistic(x, y, rounds=1)
