from __future__ import annotations

import gzip
import hashlib
import zipfile

import pytest

from strandwork.sources import files, sinks


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_bytes("﻿id\ttext\n01\ta,b\n02\t\n".encode())
    df = files.scan_delimited(spark, str(tmp_path / "a.tsv"))
    assert [tuple(r) for r in df.collect()] == [("01", "a,b"), ("02", "")]
    (tmp_path / "b.csv").write_bytes('id,text\n1,"x\ny"\n2,caf\xe9\n'.encode("latin-1"))
    df = files.scan_delimited(spark, str(tmp_path / "b.csv"), encoding="ISO-8859-1")
    assert [r["text"] for r in df.collect()] == ["x\ny", "café"]
    with pytest.raises(ValueError):
        files.scan_delimited(spark, str(tmp_path / "b.csv"), required=("nope",))


def test_multiline_records(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("app_id\ttitle\tnotes\n1\tA\tfirst\nsecond\t line\n\n2\tB\n3\tC\tx\n")
    got = [tuple(r) for r in files.scan_multiline_records(spark, str(tmp_path / "m.tsv"), ["app_id", "title", "notes"]).collect()]
    assert got == [("1", "A", "first second line"), ("2", "B", ""), ("3", "C", "x")]


def test_packed_texts_and_digests(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.txt.gz").write_bytes(gzip.compress(b"hello"))
    with zipfile.ZipFile(tmp_path / "p" / "y.zip", "w") as z:
        z.writestr(".hidden.txt", "no")
        z.writestr("d/inner.csv", "a,b")
    got = {r["name"]: r["text"] for r in files.scan_packed(spark, str(tmp_path / "p")).collect()}
    assert got == {"x.txt": "hello", "d/inner.csv": "a,b"}
    digests = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_digests(spark, str(tmp_path / "p")).collect()}
    assert digests["x.txt.gz"] == hashlib.sha256((tmp_path / "p" / "x.txt.gz").read_bytes()).hexdigest()


def test_texts_html_and_json(spark, tmp_path):
    (tmp_path / "n" / "deep").mkdir(parents=True)
    (tmp_path / "n" / "deep" / "a.md").write_text("# Hi")
    (tmp_path / "n" / "b.txt").write_text("no")
    assert [r["text"] for r in files.scan_texts(spark, str(tmp_path / "n")).collect()] == ["# Hi"]
    page = "<h2>2 Applications</h2><table><tr><td><a href='app.cgi?id=7'>7</a></td><td>One <b>title</b></td></tr><tr><td id=\"a9\">9</td><td>Two</td></tr><tr><td><a href='app.cgi?id=7'>7</a></td><td>Again</td></tr></table><h2>Other</h2><tr><td>id=1</td></tr>"
    pages = spark.createDataFrame([("p", page), ("q", "<p>none</p>"), ("r", None)], "name string, html string")
    assert [(r["name"], r["id"], r["title"]) for r in files.html_rows(pages, "html").orderBy("pos").collect()] == [("p", 7, "One title"), ("p", 9, "Two")]
    (tmp_path / "j.json").write_text('{"a": 1}')
    (tmp_path / "k.json").write_text("{broken")
    assert sorted(str(r["a"]) for r in files.scan_json(spark, str(tmp_path / "[jk].json"), "a int, _corrupt_record string").collect()) == ["1", "None"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, float("nan"), "x|y"), (2, "b", 0.5, "z")], "id int, t string, v double, _k string")
    sinks.write_delimited(df, str(tmp_path / "out"), ["v", "id", "t", "missing"], files=1)
    back = files.scan_delimited(spark, str(tmp_path / "out"))
    assert back.columns == ["v", "id", "t", "missing"] and sorted(tuple(r) for r in back.collect()) == [("", "1", "", ""), ("0.5", "2", "b", "")]
    with pytest.raises(ValueError):
        sinks.write_delimited(df, str(tmp_path / "no"), ["id"], strict=True)
    sinks.write_json(df.select("t", "id"), str(tmp_path / "json"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"id":1}', '{"id":2,"t":"b"}']
    sinks.write_per_entity(df, "id", "t", str(tmp_path / "per"))
    assert (tmp_path / "per" / "id=2").exists()
    assert sinks.markdown_table(df.select("id", "_k").orderBy("id")).splitlines()[2] == "| 1 | x\\|y |"
    assert sinks.markdown_table(df.limit(0)) == "_No rows._"
    text = sinks.markdown_table(df.orderBy("id"), ["id"], limit=1)
    assert text.splitlines()[2:] == ["| 1 |", "", "_Only the first 1 rows._"] and len(sinks.markdown_table(spark.range(150)).splitlines()) == 152
    assert sinks.preferred_order(df, ["v", "new"]) == ["v", "new", "id", "t"]
    assert r"x|y & 50\% a\_b" in sinks.latex_table(spark.createDataFrame([("x|y", "50% a_b")], "a string, b string"))


def test_sniffing_looks_at_more_than_one_line():
    assert files.sniff_separator("a\tb\n1\t2,3\n") == "\t" and files.sniff_separator("a;b,c;d\n1;2;3\n4;5,6,7;8\n") == ";" and files.sniff_separator("one\ntwo") == "," == files.sniff_separator("")
    assert files.sniff_separator("a|b\n" * 3000) == "|"


def test_records_run_over_splits(spark, tmp_path):
    rows = [(i, f"title {i}", " ".join(f"w{k}" for k in range(i % 7))) for i in range(1, 400)]
    (tmp_path / "big.tsv").write_text("id\ttitle\tnotes\n" + "".join(f"{i}\t{t}\t" + n.replace(" ", "\n") + "\n" for i, t, n in rows))
    (tmp_path / "second.tsv").write_text("lost line\n5\tx\ty\nz\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        df = files.scan_multiline_records(spark, str(tmp_path), ["id", "title", "notes"])
        assert sorted(tuple(r) for r in df.collect()) == sorted([(str(i), t, n) for i, t, n in rows] + [("5", "x", "y z")])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_catalogue_of_fields(spark, tmp_path):
    spark.range(1).selectExpr("id", "'x' as t").write.parquet(str(tmp_path / "t"))
    assert [tuple(r)[:3] for r in files.field_catalogue(spark, str(tmp_path / "t")).collect()] == [(1, "id", "bigint"), (2, "t", "string")]
