"""Queries of the streaming plans, run as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.plans.registry import Register
from strandwork.sources.tables import table
from strandwork.streaming.windows import first_seen, windowed

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


@register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_tumbling_1h(spark: SparkSession, folder: str) -> DataFrame:
    return windowed(first_seen(table(spark, folder, "events"))).withColumn("total", F.round("total", 6))
