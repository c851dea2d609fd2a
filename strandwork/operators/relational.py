"""Keyed lookups, bridges, overlays and reconciliation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last by ``order``.

    An aggregation rather than a ranking window: rows of a hot key fold into one per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def duplicate_audit(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """(keys, copies, variants, exact): keys with more than one row, and whether all their rows say the same."""
    said = F.xxhash64(*payload)
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"), F.min(said).alias("__lo"), F.max(said).alias("__hi"))
        .filter("copies > 1")
        .select(*keys, "copies", (F.col("__lo") == F.col("__hi")).alias("exact"))
    )


def lookup(left: DataFrame, right: DataFrame, key: str, order: list[str], keep: str = "last") -> DataFrame:
    """Left outer join to the first or last row of each key on the right; misses stay null."""
    return left.join(dedupe(right.filter(F.col(key).isNotNull()), [key], order, keep), key, "left")


def bridge(links: DataFrame, a: DataFrame, b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """The distinct pairs of a link table with ``issue``: ``ok``, ``no_a``, ``no_b``, ``neither`` or ``bad_key``.

    ``a`` and ``b`` have one row per key. Pairs are made distinct first, so repeated links cost one row per task.
    """
    pairs = links.groupBy(a_key, b_key).agg(F.count("*").alias("copies"))
    has_a, has_b = a.select(a_key, F.lit(True).alias("__a")), b.select(b_key, F.lit(True).alias("__b"))
    joined = pairs.join(has_a, a_key, "left").join(has_b, b_key, "left")
    in_a, in_b = F.coalesce("__a", F.lit(False)), F.coalesce("__b", F.lit(False))
    issue = F.when(F.col(a_key).isNull() | F.col(b_key).isNull(), "bad_key").when(~in_a & ~in_b, "neither").when(~in_a, "no_a").when(~in_b, "no_b").otherwise("ok")
    return joined.select(a_key, b_key, "copies", issue.alias("issue"))


def phrases_in(df: DataFrame, text: str, phrases: list[str], out: str = "phrase", limit: int = 5_000) -> DataFrame:
    """A row per row and phrase whose padded form its normalised text holds; the phrases are literals, no join is made."""
    if len(phrases) > limit:
        raise ValueError(f"{len(phrases)} phrases; pass at most {limit}, or join on their words")
    hay = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    hits = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col("__hay"), F.concat(F.lit(" "), p, F.lit(" "))))
    return df.withColumn("__hay", hay).withColumn(out, F.explode(hits)).drop("__hay")


def overlay(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Right-biased merge: rows of ``changes`` replace rows of ``base`` with their key column by column where present, and new keys are added."""
    columns = [c for c in base.columns if c not in keys]
    marked = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__changed"))
    joined = base.join(marked, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"__{c}", c).alias(c) for c in columns], F.coalesce("__changed", F.lit(False)).alias("changed"))


def reconcile(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many keys both have, are missing and are extra, and PASS or FAIL."""
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(1)).join(observed.select(*keys).distinct().withColumn("__o", F.lit(1)), keys, "full_outer")
    missing, extra = F.count(F.when(F.col("__o").isNull(), 1)), F.count(F.when(F.col("__e").isNull(), 1))
    return both.agg(
        F.count(F.when(F.col("__e").isNotNull() & F.col("__o").isNotNull(), 1)).alias("matched"), missing.alias("missing"), extra.alias("extra"),
        F.when((missing == 0) & (extra == 0), "PASS").otherwise("FAIL").alias("status"),
    )


def first_rule(df: DataFrame, id_: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(id, layer, name): the first of the ordered rules that any row of an id meets; ids that meet none give no row."""
    order = F.coalesce(*[F.when(rule, i) for i, (_, rule) in enumerate(rules)])
    names = F.array(*[F.lit(n) for n, _ in rules])
    return df.select(id_, order.alias("layer")).filter("layer is not null").groupBy(id_).agg(F.min("layer").alias("layer")).withColumn("name", names[F.col("layer")])


def net_additions(layers: DataFrame, id_: str = "id", layer: str = "layer", count: int = 0) -> DataFrame:
    """(layer, members, new, cumulative) of ordered channels: an id is new in the first channel that holds it."""
    sizes = layers.distinct().groupBy(layer).agg(F.count("*").alias("members"))
    firsts = layers.groupBy(id_).agg(F.min(layer).alias(layer)).groupBy(layer).agg(F.count("*").alias("new"))
    joined = sizes.join(firsts, layer, "left").select(layer, "members", F.coalesce("new", F.lit(0)).alias("new"))
    # one row per channel
    from pyspark.sql import Window

    return joined.withColumn("cumulative", F.sum("new").over(Window.orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)))


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Slots of a bit set, a power of two: 2 MB each, whatever is entered.
_SLOTS = 1 << 24


def _phrase_bits(asked: DataFrame, phrase: str) -> tuple[bytes, bytes]:
    """Two bit sets by checksum: of the phrases' first 1, 2, 4, ... words, and of the whole phrases."""
    first = "transform(sequence(0, length(bin(size(w))) - 1), k -> named_struct('whole', 0, 'x', array_join(slice(w, 1, shiftleft(1, k)), ' ')))"
    entries = asked.select(F.col(phrase).alias("p"), F.split(phrase, " ").alias("w")).selectExpr(f"inline(concat({first}, array(named_struct('whole', 1, 'x', p))))")
    slots = entries.select("whole", F.crc32("x").bitwiseAND(F.lit(_SLOTS - 1)).alias("s"))
    parts = slots.groupBy("whole", F.shiftright("s", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias("bits"))
    sets = bytearray(_SLOTS // 8), bytearray(_SLOTS // 8)
    for r in parts.collect():  # at most 1,024 rows of 4 kB
        sets[r["whole"]][r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    return bytes(sets[0]), bytes(sets[1])


def _phrase_search(starts: bytes, wholes: bytes) -> Callable[[str], set[bytes]]:
    """A search for the runs of words of a text that the bit sets don't rule out: all phrases that it holds, and few others."""
    last = _SLOTS - 1
    # most words open no phrase, and most texts repeat the words of others
    opens = lru_cache(1 << 17)(lambda word: starts[((crc := crc32(word)) & last) >> 3] >> (crc & 7) & 1)

    def search(text: str) -> set[bytes]:
        words, found = text.encode().split(b" "), set()
        for i, word in enumerate(words):
            if not opens(word):
                continue
            crc = crc32(word)
            for n in range(1, len(words) - i + 1):
                if n > 1:
                    crc = crc32(b" " + words[i + n - 1], crc)
                at, bit = (crc & last) >> 3, crc & 7
                if wholes[at] >> bit & 1:
                    found.add(b" ".join(words[i : i + n]))
                if not n & (n - 1) and not starts[at] >> bit & 1:
                    break
        return found

    return search


def phrase_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """The columns of ``texts`` but ``text`` and each distinct ``phrase`` of the other table that the text holds as whole words.

    Both sides are compared in lower case with everything but letters and digits as one blank. Texts aren't shuffled: each task looks their
    runs of words up in bit sets of the phrases, which have a fixed size, and only runs that may be phrases are joined with the phrases, which
    decides. So no product of the tables is made and neither has to fit in memory; from millions of phrases on, the bit sets rule out
    less and more is shuffled, with the same result. Null and blank texts and phrases give no row; repeated rows stay.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    asked = phrases.select(norm(F.col(phrase)).alias(phrase)).filter(F.col(phrase) != "").distinct()
    keep = [c for c in texts.columns if c not in (text, phrase)]
    rows = texts.select(*keep, norm(F.col(text)).alias("__t"))
    sets = texts.sparkSession.sparkContext.broadcast(_phrase_bits(asked, phrase))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _phrase_search(*sets.value)
        for batch in batches:
            for part in (batch.slice(k, 1_000) for k in range(0, batch.num_rows, 1_000)):
                hits = [(i, x) for i, t in enumerate(part.column(len(keep)).to_pylist()) if t for x in search(t)]
                at = pa.array([i for i, _ in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in part.columns[:-1]], pa.array([x.decode() for _, x in hits], pa.string())], names=[*keep, phrase])

    held = rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField(phrase, StringType())]))
    return held.join(asked, phrase).select(*keep, phrase)


def split_with_contract(df: DataFrame, condition: Column, **expected: int) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition and those that don't (or have null); two names give the sizes they must have, else it raises.

    Both sizes come from one pass.
    """
    (first, n), (second, m) = expected.items()
    holds = F.coalesce(condition, F.lit(False))
    got = df.agg(F.count_if(holds).alias("n"), F.count_if(~holds).alias("m")).first()
    if (got["n"], got["m"]) != (n, m):
        raise ValueError(f"{first} has {got['n']} rows instead of {n}, {second} {got['m']} instead of {m}")
    return df.filter(holds), df.filter(~holds)
