from __future__ import annotations

import pytest

from strandwork.operators.split_values import infer_rules, split_values

CELLS = [
    (1, "doi", "10.5555/a.1;10.5555/2018;3-mp"),
    (2, "doi", '"10.5555/a" , "10.5555/b"'),
    (3, "doi", "['10.5555/a', 'doi:10.5555/b']"),
    (4, "doi", "10.5555/2018471747;3-mp"),
    (5, "doi", "10.5555/x 10.5555/y\r\n10.5555/x"),
    (6, "n", "1;2|3 / 4 and 5"),
    (7, "n", "7 ;"),
    (8, "n", ";8;9"),
    (9, "n", "1||2"),
    (10, "n", None),
    (11, "n", "  "),
    (12, "u", "https://a.example/x;fmt=txt;\nhttps://b.example/l,v2.html"),
    (13, "u", "https://a.example/x"),
]
EXPECTED = {
    1: ["10.5555/a.1", "10.5555/2018;3-mp"], 2: ["10.5555/a", "10.5555/b"], 3: ["10.5555/a", "doi:10.5555/b"], 5: ["10.5555/x", "10.5555/y", "10.5555/x"],
    6: ["1", "2", "3", "4", "5"], 8: ["8", "9"], 9: ["1", "2"], 12: ["https://a.example/x;fmt=txt", "https://b.example/l,v2.html"],
}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, "id int, source string, cell string")


def test_values_with_positions(cells):
    got: dict[int, dict[int, str]] = {}
    for r in split_values(cells, "source", "cell", at_least=2).collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["item_value"]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == EXPECTED
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in got.values())


def test_single_values_and_order_of_cells(cells):
    single = {r["id"]: r["item_value"] for r in split_values(cells, "source", "cell").collect() if r["id"] in (4, 7, 13)}
    assert single == {4: "10.5555/2018471747;3-mp", 7: "7", 13: "https://a.example/x"}


def test_inferred_rules(cells):
    rules = infer_rules(cells, "source", "cell")
    assert {k: r.kind for k, r in rules.items()} == {"doi": "doi", "n": "number", "u": "address"}
    assert "semicolon" in rules["n"].delimiters and "tab" not in rules["n"].delimiters


def test_marks_within_values_are_rejected(spark):
    """The scores decide: no beginning of a value stands between a comma in a name and a cut."""
    names = ["Ames, Jo; Bell, Li", "Cole, Al", "Dunn, Bo; Eves, Cy; Ford, Di", "Gray, Ed", "Hale, Fi; Ives, Gus", "Jack, Hal"]
    dois = ["10.5555/a-b.c_d;10.5555/e-f.g", "10.5555/h.i-j", "10.5555/k_l;10.5555/m-n"]
    rows = [("names", n) for n in names] + [("dois", d) for d in dois]
    df = spark.createDataFrame(rows, "source string, cell string")
    rules = infer_rules(df, "source", "cell")
    assert rules["names"].delimiters == rules["dois"].delimiters == ("semicolon",)
    scores = dict(rules["names"].scores)
    assert scores["semicolon"] == 1.0 and scores["comma"] == scores["space"] == 0.0
    assert {"dot", "hyphen", "underscore"} <= {k for k, v in rules["dois"].scores if v < 0.05}
    got = sorted(r["item_value"] for r in split_values(df.filter("source = 'names'"), "source", "cell").collect())
    assert got == sorted(v for n in names for v in n.split("; "))


def test_edges(spark, cells):
    assert split_values(cells.limit(0), "source", "cell").count() == 0
    clash = split_values(cells.withColumnsRenamed({"id": "pos"}).selectExpr("*", "'x' as item_value", "1 as __q"), "source", "cell")
    assert clash.columns == ["source", "__q", "pos", "item_value"] and clash.filter("item_value = 'x'").count() == 0
    long = spark.createDataFrame([(1, "n", ";".join(map(str, range(20_000)))), (1, "n", "1;2"), (1, "n", "1;2"), (2, None, "1;2")], "id int, source string, cell string")
    out = split_values(long, "source", "cell", at_least=2)
    assert out.count() == 20_004  # a cell without source stays whole, repeated cells stay repeated
    odd = spark.createDataFrame([(1, "n", ";" * 200_000 + "1" + ' ;"' * 100_000 + "2"), (2, "n", "1;2"), (3, "n", '"' * 200_000), (4, "n", "1" + " " * 200_000 + "2")], "id int, source string, cell string")
    assert sorted((r["id"], r["item_value"]) for r in split_values(odd, "source", "cell").collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (4, "1"), (4, "2")]
    words = spark.createDataFrame([(1, "t", "alpha beta; gamma"), (2, "t", "delta and co; x")], "id int, source string, cell string")
    assert sorted(r["item_value"] for r in split_values(words, "source", "cell").collect()) == ["alpha beta", "delta and co", "gamma", "x"]
