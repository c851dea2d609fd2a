from __future__ import annotations

import random

from strandwork.llm.passages import WuManber, leaked_passages, words

random.seed(8)
VOCABULARY = [f"w{i}x" for i in range(400)]
ITEMS = {i: [random.choice(VOCABULARY) for _ in range(60)] for i in range(1, 13)}


def noise(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


def test_words():
    assert words("The <b>Big</b>, bro-\n> ken &amp; ﬁne soft­ly\n<p>end</p>") == ["the", "big", "broken", "fine", "softly", "end"]
    assert words(None) == words("") == words("  \n") == []
    assert words(f'two <img src="{"x" * 5000}"> words') == ["two", "words"]  # a tag of any length


def test_hits_as_brute_force():
    index = WuManber(list(ITEMS.items()))
    for _ in range(30):
        text = noise(40) + ITEMS[random.randint(1, 12)][10 : 10 + random.randint(2, 30)] + noise(20)
        expected = {(i, p - q) for i, w in ITEMS.items() for p in range(len(text) - 2) for q in range(len(w) - 2) if text[p : p + 3] == w[q : q + 3]}
        assert index.hits(text) == expected


def run(spark, docs, items=None, **k):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int, words string")
    i = spark.createDataFrame([(a, " ".join(b)) for a, b in (items or ITEMS).items()] + [(None, "x"), (99, None), (98, ""), (97, " ")], "item_id long, item_text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaked_passages(d, i, **k).collect())


def test_leaks_and_what_is_none(spark):
    changed = ITEMS[2][5:35]
    changed[7], changed[8], changed[20] = "zzz", "yyy", "qqq"
    docs = [
        (1, " ".join(noise(50) + ITEMS[1] + noise(50))),
        (2, " ".join(w.upper() + "," for w in changed)),
        (3, " ".join(noise(30) + ITEMS[3][:12] + noise(30) + ITEMS[3][12:24])),  # two short quotes
        (4, "<p>" + "\n> ".join(ITEMS[4][20:45]) + "</p>" + " ".join(ITEMS[5][:21])),
        (5, None), (6, ""), (7, "   "), (8, " ".join(noise(200_000) + ITEMS[6][30:55])), (9, " ".join(ITEMS[1])), (9, " ".join(ITEMS[1])),
    ]
    expected = [(1, 1), (2, 2), (4, 4), (4, 5), (8, 6), (9, 1), (9, 1)]
    rows = [(d, t, 0, "clash") for d, t in docs]
    assert run(spark, rows) == expected
    assert run(spark, rows, max_words=100) == expected  # the items in blocks


def test_short_items_and_empty_tables(spark):
    items = {1: ["solo"], 2: ["two", "words"], 3: noise(30)}
    assert run(spark, [(1, "a solo b", 0, ""), (2, "two words", 0, ""), (3, "two or words", 0, "")], items) == [(1, 1), (2, 2)]
    assert run(spark, []) == []
    none = spark.createDataFrame([], "item_id long, item_text string")
    assert leaked_passages(spark.createDataFrame([(1, "x")], "doc_id long, text string"), none).count() == 0
