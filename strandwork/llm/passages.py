"""Problem 9: passages of evaluation items inside corpus texts, by Wu-Manber search over words.

The patterns are all windows of a few words of the items; the symbols are words, compared regardless of case, punctuation,
markup, line breaks and hyphenation. A shift table over blocks of two words lets the scan skip where no pattern can
end; where one can, the bucket of the block names the places in the items, the words before it are compared, and
the hit is extended along its diagonal to the segment that repeats the item, single changed words included.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.session import cut
from strandwork.sources.tables import table

_INVISIBLE = re.compile("[­​-‏  ‪-‮⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*[\r\n][\s>|*#]*(?=\w)")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in one form; none for null, empty and blank texts."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m.group()[1:3].lower() in ("b>", "i>", "em") or m.group().lower() in ("</b>", "</i>", "</em>", "<strong>", "</strong>") else " ", text)
    return _WORD.findall(_HYPHEN.sub("", text).casefold())


class WuManber:
    """Shift table, suffix buckets and direct comparison over the word windows of a set of items."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = 3):
        self.items = {i: w for i, w in items if w}
        #: length of a pattern: no longer than the shortest item, so that none is left out
        self.m = max(1, min([window, *map(len, self.items.values())]))
        self.block = min(2, self.m)
        self.longest = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple[int, int]]] = {}
        for i, w in self.items.items():
            for end in range(self.block - 1, len(w)):
                key = tuple(w[end - self.block + 1 : end + 1])
                left = max(0, self.m - 1 - end)  # words between this block and the end of the first pattern that holds it
                self.shift[key] = min(left, self.shift.get(key, self.longest))
                if end >= self.m - 1:
                    self.bucket.setdefault(key, []).append((i, end))

    def hits(self, text: list[str]) -> set[tuple[int, int]]:
        """(item, diagonal) of every pattern that occurs: word p of the item lies at p + diagonal of the text."""
        found, p, m, b = set(), self.m - 1, self.m, self.block
        while p < len(text):
            key = tuple(text[p - b + 1 : p + 1])
            skip = self.shift.get(key, self.longest)
            if skip == 0:
                for i, end in self.bucket[key]:
                    item = self.items[i]
                    if (i, p - end) not in found and item[end - m + 1 : end - b + 1] == text[p - m + 1 : p - b + 1]:
                        found.add((i, p - end))
                skip = 1
            p += skip
        return found

    def segment(self, text: list[str], item: int, diagonal: int, penalty: float) -> tuple[int, int]:
        """Words and equal words of the segment of the diagonal with the highest score: 1 a word, ``-penalty`` a changed one."""
        words_ = self.items[item]
        best = (0.0, 0, 0)
        score, start, same = 0.0, 0, 0
        for k in range(max(0, -diagonal), min(len(words_), len(text) - diagonal)):
            if score <= 0:
                score, start, same = 0.0, k, 0
            if words_[k] == text[k + diagonal]:
                score += 1
                same += 1
                if score > best[0]:
                    best = (score, k - start + 1, same)
            else:
                score -= penalty
        return best[1], best[2]

    def leaks(self, text: str | None, least: int, penalty: float) -> list[tuple[int, int, int]]:
        """(item, words, equal words) of each item of which ``least`` words on end, or all of a shorter one, occur."""
        text_words = words(text)
        best: dict[int, tuple[int, int]] = {}
        for i, diagonal in self.hits(text_words):
            best[i] = max(best.get(i, (0, 0)), self.segment(text_words, i, diagonal, penalty))
        return [(i, n, same) for i, (n, same) in sorted(best.items()) if n >= min(least, len(self.items[i]))]


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    least: int = 20,
    penalty: float = 1.5,
    max_words: int = 1_000_000,
) -> DataFrame:
    """(doc id, item id, words, same_words), a row per document row and item whose passage it holds.

    The items' tables go to every task while their words stay under ``max_words``, which is counted first; a larger set is cut
    into blocks of items and the corpus is searched once per block, one block after the other, with the same result. The corpus is never shuffled, texts are
    searched whole, and null, empty and blank texts and items give no row. Repeated documents each give their rows.
    """
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = max(1, math.ceil(total / max_words))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    schema = "doc_id bigint, item_id bigint, words int, same_words int"

    def search(rows: list) -> tuple[DataFrame, Broadcast]:
        tables = docs.sparkSession.sparkContext.broadcast([(r["i"], words(r["t"])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = WuManber(tables.value)
            for batch in batches:
                out: list[tuple] = []
                if index.items:
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        out.extend((d, *x) for x in index.leaks(t, least, penalty))
                columns = list(zip(*out)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "words", "same_words"])

        return source.mapInArrow(run, schema), tables

    if blocks == 1:
        return search(items.collect())[0]
    parts = []
    for b in range(blocks):  # one block after another: neither the driver nor a task ever holds two
        found, tables = search(items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect())
        parts.append(cut(found))
        tables.unpersist()
    return reduce(DataFrame.unionAll, parts)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item, and the longest passage."""
    found = leaked_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("words").alias("longest_words"))


QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
ORACLE_SQL: dict[str, str] = {}
