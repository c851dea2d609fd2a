"""Calendar spines, periods, month arithmetic and gap-filled series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spine(spark: SparkSession, start: str, end: str, step: str = "1 month", out: str = "period") -> DataFrame:
    """Every period start from ``start`` to ``end``, both included."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {step})")).alias(out))


def gap_filled(spine_: DataFrame, counts: DataFrame, on: str, values: list[str]) -> DataFrame:
    """The spine with ``values``, 0 where a period has none. ``counts`` has a row per period."""
    return spine_.join(counts, on, "left").select(on, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def month_first(day: Column, months: int) -> Column:
    """The first day of the month ``months`` later."""
    return F.trunc(F.add_months(day, months), "MM")


def calendar_months(a: Column, b: Column) -> Column:
    """Months between the months of two days, their days ignored."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def completed_months(a: Column, b: Column) -> Column:
    """Whole months that have passed: one less if the day of the month isn't reached."""
    return calendar_months(a, b) - F.when(F.day(b) < F.day(a), 1).otherwise(0)


def label(day: Column, unit: str) -> Column:
    """``YYYY-MM``, ``YYYYQn``, ``YYYYHn`` or the ISO week ``YYYY-Www`` of a day."""
    year = F.year(day).cast("string")
    if unit == "month":
        return F.date_format(day, "yyyy-MM")
    if unit == "quarter":
        return F.concat(year, F.lit("Q"), F.quarter(day))
    if unit == "half":
        return F.concat(year, F.lit("H"), F.when(F.month(day) <= 6, 1).otherwise(2))
    if unit == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    raise ValueError(unit)


def strict_date(text: Column) -> Column:
    """A day written ``YYYY-MM-DD``; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def lenient_date(text: Column) -> Column:
    """As ``strict_date``, but a year alone is its first of January."""
    t = F.trim(text)
    return F.coalesce(strict_date(t), F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01")), F.lit("yyyy-MM-dd")).cast("date")))


def at_risk_panel(entities: DataFrame, id_: str, start: str, periods: list[tuple[str, str]], censor: str | None = None) -> DataFrame:
    """(id, period_start, period_end, at_risk_days, first_partial) for every period from an entity's start on.

    ``periods`` are literals (first day, last day): each entity's own periods are generated from its start, so no join is
    made and no row that isn't at risk ever exists. ``censor`` names a column with the last day at risk.
    """
    array = F.array(*[F.struct(F.lit(a).cast("date").alias("period_start"), F.lit(b).cast("date").alias("period_end")) for a, b in periods])
    last = F.coalesce(F.col(censor), F.lit("9999-12-31").cast("date")) if censor else F.lit("9999-12-31").cast("date")
    own = F.filter(array, lambda p: (p["period_end"] >= F.col(start)) & (p["period_start"] <= last))
    at_risk = F.datediff(F.least("period_end", last), F.greatest("period_start", F.col(start))) + 1
    return entities.select(id_, start, *([censor] if censor else []), F.inline(own)).select(id_, "period_start", "period_end", at_risk.alias("at_risk_days"), (F.col(start) > F.col("period_start")).alias("first_partial"))
