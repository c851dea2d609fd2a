from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwork.llm import tokens as K

if not os.path.exists(K.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)

TINY = K.TreeEncoder(leaf_chars=3, window=1)
WHOLE = K.TreeEncoder(leaf_chars=1 << 30)
ALPHABET = "a'restvlmdnA01 \n\t  é数漢-.!?😀　'́<|>"


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=80))
def test_halves_give_what_the_whole_gives(text):
    assert TINY.encode(text) == WHOLE.encode(text) == WHOLE._core.encode_ordinary(text)
    assert TINY.decode(TINY.encode(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert TINY.encode(text) == WHOLE.encode(text) and TINY.decode(TINY.encode(text)) == text


def test_against_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(K.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ("They're <|endoftext|> here", "  two  blanks ", "x" * 5000 + "   " * 900 + "1234567890" * 50, "日本語のテキスト", "\r\n\r\n a"):
        assert K.TreeEncoder(leaf_chars=64).encode(text) == other.encode(text, add_special_tokens=False).ids


def test_column_of_texts(spark):
    long = "word " * 60_000
    rows = [(1, None, 9), (2, "", 9), (3, " ", 9), (4, "same", 9), (4, "same", 9), (None, long, 9)]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    out = K.encode_texts(df)
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    assert out.columns == ["doc_id", "text", "ids"] and got[0][1] == got[1][1] == [] and got[2][1] == WHOLE.encode(" ") and got[3] == got[4]
    assert got[5][1] == WHOLE.encode(long)
    assert [r["back"] for r in K.decode_ids(out, "ids", "back").select("back").collect()][1:5] == ["", " ", "same", "same"]
    assert K.encode_texts(df.limit(0)).count() == 0
