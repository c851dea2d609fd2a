"""Weights, ordered joins of strings and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fractional_weights(pairs: DataFrame, key: str, out: str) -> DataFrame:
    """Each row of distinct pairs weighted by one over the number of rows of its key, so that every key adds up to one.

    The counts are aggregated and joined back (one row per key on the right) instead of a window that would gather a hot
    key in one task.
    """
    sizes = pairs.groupBy(key).agg(F.count("*").alias("__n"))
    return pairs.join(sizes, key).withColumn(out, 1.0 / F.col("__n")).drop("__n")


def unique_joined(df: DataFrame, keys: list[str], value: str, order: str, out: str, sep: str = "; ") -> DataFrame:
    """(keys, out, n): the distinct values of each key in the order of their first appearance, joined.

    Values are made distinct before they are gathered: a key's list is as long as its distinct values, not its rows.
    """
    first = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("__k"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("__k", value))), lambda x: x[value])
    return first.groupBy(*keys).agg(F.array_join(values, sep).alias(out), F.count("*").alias("n"))


def coverage(df: DataFrame) -> DataFrame:
    """(variable, filled, missing, pct) of every column, in one pass; blanks are missing."""
    filled = [F.count_if(F.trim(F.col(f"`{c}`").cast("string")) != "").alias(f"c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count("*").alias("__n"), *filled)
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("filled")) for i, c in enumerate(df.columns)])
    return one.select("__n", F.inline(rows)).select("variable", "filled", (F.col("__n") - F.col("filled")).alias("missing"), F.round(F.try_divide(100.0 * F.col("filled"), F.col("__n")), 4).alias("pct"))
