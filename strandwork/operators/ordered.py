"""Ranks, running values and exact quantiles that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.session import cut


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    The filter on the rank lets the planner put a group limit before the shuffle, so every task sends at most ``k``
    rows of a key, however hot. Ties are settled by ``order``, which should be total.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q, n, lower, upper, quantile): linear interpolation between order statistics at (n-1)q, for columns of any length.

    Values are counted first and sorted by range over all tasks; positions come from each range's rows and the
    totals of the ranges before it (one row per range and key). No task or driver ever holds a whole column. Nulls don't count.
    """
    keys = keys or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    spread = counts.repartitionByRange("v").withColumn("__part", F.spark_partition_id())
    spread = cut(spread)
    ranges = spread.groupBy(*keys, "__part").agg(F.sum("c").alias("s"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__before", F.coalesce(F.sum("s").over(before), F.lit(0))).withColumn("n", F.sum("s").over(Window.partitionBy(*keys)))
    within = Window.partitionBy(*keys, "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = spread.withColumn("__in", F.sum("c").over(within)).join(offsets.drop("s"), [*keys, "__part"]).withColumn("last", F.col("__before") + F.col("__in") - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    wanted = placed.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn("at", (F.col("n") - 1) * F.col("q"))
    lo, hi = F.floor("at"), F.ceil("at")
    picked = wanted.groupBy(*keys, "q").agg(
        F.max("n").alias("n"), F.max("at").alias("at"), F.max(F.when(lo.between(F.col("first"), F.col("last")), F.col("v"))).alias("lower"), F.max(F.when(hi.between(F.col("first"), F.col("last")), F.col("v"))).alias("upper")
    )
    return picked.withColumn("quantile", F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))).drop("at")


def holm(df: DataFrame, family: list[str], p: str, tie: str, out: str = "holm_p") -> DataFrame:
    """Step-down adjusted p-values within each (small) family of tests."""
    order = Window.partitionBy(*family).orderBy(p, tie)
    whole = Window.partitionBy(*family)
    scaled = F.col(p) * (F.count("*").over(whole) - F.row_number().over(order) + 1)
    return df.withColumn("__s", scaled).withColumn(out, F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")
