"""Phrases of titles, found from counts: neighbours that occur together far more often than apart are one phrase.

No list of words is used. Words are glued where a pair is frequent against its words (pair lift) and its words seldom do without
each other; a rare phrase one letter off a common one is read as that one; phrases that almost every title has, or hardly
any, are left out. All counts run over all distinct titles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.names import fold
from strandwork.session import cut

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without case, accents and apostrophes."""
    return _WORD.findall(fold(text).casefold().replace("'", "").replace("’", ""))


def title_keys(df: DataFrame, id_: str, title: str) -> DataFrame:
    """(id, key): the words of each title in one form. Titles without a word, null ones included, give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [" ".join(words(t)) or None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["id", "key"])

    source = df.select(F.col(id_).cast("bigint").alias("id"), F.col(title).cast("string").alias("title")).filter("id is not null and title is not null")
    return source.mapInArrow(run, "id bigint, key string").filter("key is not null").distinct()


def deletions(word: Column) -> Column:
    """The word and the word without each of its letters: words one edit or swap apart share one of these."""
    return F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))))


def glued_pairs(titles: DataFrame, lift: float, share: float, least: int) -> DataFrame:
    """(a, b): neighbouring words that belong together; ``titles`` has key and w, its words."""
    total = titles.agg(F.sum(F.size("w"))).first()[0] or 0
    single = titles.select(F.explode("w").alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    pairs = titles.filter(F.size("w") > 1).select(F.inline(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))))
    both = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    both = both.join(single.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b")
    return both.filter(((F.col("n") - 2) * float(total) / (F.col("na") * F.col("nb")) >= lift) & (F.col("n") / F.least("na", "nb") >= share)).select("a", "b")


def title_phrases(keys: DataFrame, lift: float = 20.0, share: float = 0.15, least: int = 3, common: int = 5, most: float = 0.06) -> DataFrame:
    """(key, phrase) of the distinct titles ``keys`` (key), without phrases of fewer than ``least`` titles or more than ``most`` of all.

    A pair is glued from a lift of ``lift`` on if it makes up ``share`` of its rarer word. Phrases of fewer than ``common``
    titles and five letters or more are read as the most frequent one that a letter left out makes equal. An empty table gives no row.
    """
    titles = cut(keys.select("key").distinct().withColumn("w", F.split("key", " ")))
    glue = glued_pairs(titles, lift, share, least)
    at = titles.filter(F.size("w") > 1).select("key", F.posexplode(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))))
    joints = at.select("key", F.col("col.a").alias("a"), F.col("col.b").alias("b"), "pos").join(glue, ["a", "b"]).groupBy("key").agg(F.collect_set("pos").alias("g"))
    marked = F.transform("w", lambda x, i: F.concat(F.when(i == 0, "").when(F.array_contains(F.coalesce("g", F.array().cast("array<int>")), i - 1), " ").otherwise("\x01"), x))
    found = cut(titles.join(joints, "key", "left").select("key", F.explode(F.array_distinct(F.split(F.array_join(marked, ""), "\x01"))).alias("phrase")))
    counts = found.groupBy("phrase").agg(F.count("*").alias("n"))
    spelled = counts.filter(F.length("phrase") >= 5)
    rare = spelled.filter(F.col("n") < common).select(F.col("phrase").alias("rare"), F.explode(deletions(F.col("phrase"))).alias("d"))
    usual = spelled.filter(F.col("n") >= common).select("phrase", "n", F.explode(deletions(F.col("phrase"))).alias("d"))
    meant = rare.join(usual, "d").filter(F.abs(F.length("rare") - F.length("phrase")) <= 1).groupBy("rare").agg(F.max(F.struct("n", "phrase"))["phrase"].alias("meant"))
    read = cut(found.join(meant, F.col("phrase") == F.col("rare"), "left").select("key", F.coalesce("meant", "phrase").alias("phrase")).distinct())
    telling = read.groupBy("phrase").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") <= most * titles.count())).select("phrase")
    return read.join(telling, "phrase").select("key", "phrase")
