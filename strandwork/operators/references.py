"""References to keys that another table doesn't hold, kept as signed counts per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole_number(text: Column) -> Column:
    """A key as a whole number: ``' 0123'``, ``'123'`` and ``'123.0'`` are the same; anything else is null."""
    return F.regexp_extract(text.cast("string"), r"(?U)^\s*([+-]?\d+)(?:\.0*)?\s*$", 1).try_cast("bigint")


def existence_deltas(rows: DataFrame, target: str, key: Column, deleted: Column) -> DataFrame:
    """+1 for each arrival and -1 for each deletion of a key of ``target``, summed per key before anything is shuffled on."""
    return (
        rows.select(F.lit(target).alias("target"), key.alias("key"), (1 - deleted.isNotNull().cast("int")).alias("held"))
        .filter(F.col("key").isNotNull())
        .groupBy("target", "key")
        .agg(F.sum("held").alias("existing"), F.lit(0).cast("bigint").alias("referring"))
    )


def key_balance(references: DataFrame, existence: DataFrame) -> DataFrame:
    """(target, key, existing, referring): the standing counts of each key from all deltas seen."""
    referring = references.groupBy("target", "key").agg(F.lit(0).cast("bigint").alias("existing"), F.count("*").alias("referring"))
    return existence.unionByName(referring).groupBy("target", "key").agg(F.sum("existing").alias("existing"), F.sum("referring").alias("referring"))


def orphan_references(references: DataFrame, existence: DataFrame) -> DataFrame:
    """The rows of ``references`` (target, key and any others) whose key has references and no existence.

    Null keys refer to nothing and give no row; a target that arrives after its reference still counts. Repeated
    references each come out. Deltas are summed before the shuffle, so a key that holds a third of all rows
    is one row per task there; the join back has one row per key on its right, and adaptive execution splits a
    hot key's partition on the left.
    """
    orphans = key_balance(references.filter(F.col("key").isNotNull()), existence).filter((F.col("referring") > 0) & (F.col("existing") <= 0)).select("target", "key")
    return references.join(orphans, ["target", "key"], "left_semi")


def apply_deltas(balance: DataFrame, deltas: DataFrame) -> DataFrame:
    """Yesterday's balance and today's signed deltas (target, key, existing, referring) to today's balance."""
    return balance.unionByName(deltas).groupBy("target", "key").agg(F.sum("existing").alias("existing"), F.sum("referring").alias("referring"))


def standing_orphans(deltas: DataFrame) -> DataFrame:
    """(target, period, orphan_keys): how many keys have references and no existence at the end of each period in which anything changed.

    ``deltas`` has target, key, period, existing and referring, the signed changes. They are summed per key and period first, so a key has
    no more rows than periods; its running balance says when it becomes an orphan and when it ceases to be one, and only these changes
    are added up over time. Null keys are left out; a null period counts as the earliest.
    """
    per = deltas.filter(F.col("key").isNotNull()).groupBy("target", "key", F.coalesce("period", F.lit("")).alias("period")).agg(F.sum("existing").alias("existing"), F.sum("referring").alias("referring"))
    run = Window.partitionBy("target", "key").orderBy("period")
    state = per.withColumn("o", ((F.sum("referring").over(run) > 0) & (F.sum("existing").over(run) <= 0)).cast("int"))
    change = state.withColumn("c", F.col("o") - F.coalesce(F.lag("o").over(run), F.lit(0)))
    by = change.groupBy("target", "period").agg(F.sum("c").alias("c"))
    return by.select("target", "period", F.sum("c").over(Window.partitionBy("target").orderBy("period")).alias("orphan_keys"))
