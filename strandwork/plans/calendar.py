"""Queries of gap-filled series, periods, panels and follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.operators import calendar as C
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


def _span(spark: SparkSession, folder: str, unit: str, start: str, end: str) -> tuple[str, str]:
    """The first and last period of the orders, but ``start`` to ``end`` at least: one aggregated row."""
    d = F.trunc("o_orderdate", unit) if unit != "day" else F.to_date("o_orderdate")
    first, last = F.least(F.min(d), F.lit(start).cast("date")), F.greatest(F.max(d), F.lit(end).cast("date"))
    return tuple(table(spark, folder, "orders").agg(first.cast("string"), last.cast("string")).first())


def _series(name: str, unit: str, step: str, start: str, end: str, interval: str):
    sql = f"""WITH c AS (SELECT date_trunc('{unit}', o_orderdate)::DATE AS period, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1)
    SELECT s.period, coalesce(urgent, 0) AS urgent, coalesce(low, 0) AS low, coalesce(urgent, 0) - coalesce(low, 0) AS difference FROM (SELECT unnest(generate_series(least(DATE '{start}', (SELECT min(period) FROM c)), greatest(DATE '{end}', (SELECT max(period) FROM c)), INTERVAL {interval}))::DATE AS period) s LEFT JOIN c USING (period)"""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        period = F.trunc("o_orderdate", unit) if unit != "day" else F.to_date("o_orderdate")
        counts = table(spark, folder, "orders").groupBy(period.alias("period")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
        return C.gap_filled(C.spine(spark, *_span(spark, folder, unit, start, end), step), counts, "period", ["urgent", "low"]).withColumn("difference", F.col("urgent") - F.col("low"))

    query.__name__ = name
    register(sql)(query)


_series("monthly_counts", "month", "1 month", "1991-06-01", "1999-03-01", "1 MONTH")
_series("quarterly_counts", "quarter", "3 months", "1991-07-01", "1999-01-01", "3 MONTH")
_series("weekly_counts", "week", "7 days", "1991-12-30", "1999-01-04", "7 DAY")
_series("daily_counts", "day", "1 day", "1991-12-01", "1999-01-31", "1 DAY")


@register(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, year(o_orderdate) || 'H' || CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS half, strftime(o_orderdate, '%G-W%V') AS week,
    date_trunc('quarter', o_orderdate)::DATE AS quarter_start, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, last_day(o_orderdate)::DATE AS month_end, year(o_orderdate) * 12 + month(o_orderdate) AS ordinal FROM orders"""
)
def period_labels(spark: SparkSession, folder: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", *[C.label(d, u).alias(u) for u in ("month", "quarter", "half", "week")], F.trunc(d, "QUARTER").alias("quarter_start"), F.date_sub(F.add_months(F.trunc(d, "QUARTER"), 3), 1).alias("quarter_end"),
        F.last_day(d).alias("month_end"), (F.year(d) * 12 + F.month(d)).cast("bigint").alias("ordinal"),
    )


@register(
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) SELECT d, date_trunc('month', d + INTERVAL 5 MONTH)::DATE AS five_months_first, (d + INTERVAL 1 MONTH)::DATE AS next_month, (d - INTERVAL 12 MONTH)::DATE AS year_before,
    (year(DATE '1998-12-15') - year(d)) * 12 + month(DATE '1998-12-15') - month(d) AS months_calendar, (year(DATE '1998-12-15') - year(d)) * 12 + month(DATE '1998-12-15') - month(d) - (15 < day(d))::INT AS months_completed FROM d"""
)
def month_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    d, end = F.col("d"), F.lit("1998-12-15").cast("date")
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", C.month_first(d, 5).alias("five_months_first"), F.add_months(d, 1).alias("next_month"), F.add_months(d, -12).alias("year_before"), C.calendar_months(d, end).cast("bigint").alias("months_calendar"), C.completed_months(d, end).cast("bigint").alias("months_completed"))


@register(
    """SELECT row_id, CASE WHEN regexp_matches(date_pub, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(date_pub, '%Y-%m-%d')::DATE END AS strict, CASE WHEN regexp_matches(trim(date_pub), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(trim(date_pub), '%Y-%m-%d')::DATE WHEN regexp_matches(trim(date_pub), '^[0-9]{4}$') THEN try_strptime(trim(date_pub) || '-01-01', '%Y-%m-%d')::DATE END AS lenient FROM schema19_publications"""
)
def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("date_pub")
    return table(spark, folder, "schema19_publications").select("row_id", C.strict_date(c).alias("strict"), C.lenient_date(c).alias("lenient"))


@register(
    """WITH k AS (SELECT unnest([1, 3, 6, 12]) AS k), p AS (SELECT DATE '1996-07-05' AS p)
    SELECT k, count(*) FILTER (o_orderdate::DATE BETWEEN (p - to_months(k))::DATE AND (p - INTERVAL 1 DAY)::DATE) AS before, count(*) FILTER (o_orderdate::DATE BETWEEN p AND (p + to_months(k))::DATE) AS after FROM orders, k, p GROUP BY k"""
)
def policy_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in the k months before a day and from it on, both ends included, for several k in one pass."""
    p, d = F.lit("1996-07-05").cast("date"), F.to_date("o_orderdate")
    sums = [f(d, k).alias(f"{n}{k}") for k in (1, 3, 6, 12) for n, f in (("b", lambda d, k: F.count_if(d.between(F.add_months(p, -k), F.date_sub(p, 1)))), ("a", lambda d, k: F.count_if(d.between(p, F.add_months(p, k)))))]
    one = table(spark, folder, "orders").agg(*sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"b{k}").alias("before"), F.col(f"a{k}").alias("after")) for k in (1, 3, 6, 12)])))


@register(
    """WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1), m AS (SELECT unnest(generate_series(least(DATE '1992-01-01', (SELECT min(date_trunc('month', o_orderdate))::DATE FROM orders)), greatest(DATE '1998-12-01', (SELECT max(date_trunc('month', o_orderdate))::DATE FROM orders)), INTERVAL 1 MONTH))::DATE AS month)
    SELECT month, count(d) AS started FROM m LEFT JOIN s ON d <= last_day(month) GROUP BY month"""
)
def point_in_time_denominator(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that had started by each month's end: a running sum of first months, not a range join."""
    first = table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d")).groupBy(F.trunc("d", "MM").alias("period")).agg(F.count("*").alias("n"))
    filled = C.gap_filled(C.spine(spark, *_span(spark, folder, "month", "1992-01-01", "1998-12-01")), first, "period", ["n"])
    return filled.select(F.col("period").alias("month"), F.sum("n").over(Window.orderBy("period")).alias("started"))


_Q = "SELECT unnest(generate_series(least(DATE '1992-01-01', (SELECT min(date_trunc('quarter', o_orderdate))::DATE FROM orders)), greatest(DATE '1998-10-01', (SELECT max(date_trunc('quarter', o_orderdate))::DATE FROM orders)), INTERVAL 3 MONTH))::DATE AS period_start"
_PANEL = f"""s AS (SELECT o_custkey, min(o_orderdate)::DATE AS start FROM orders GROUP BY 1), q AS (SELECT period_start, (period_start + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end FROM ({_Q})),
c AS (SELECT o_custkey, date_trunc('quarter', o_orderdate)::DATE AS period_start, count(*) AS n FROM orders GROUP BY 1, 2),
panel AS (SELECT s.o_custkey, q.period_start, q.period_end, date_diff('day', greatest(q.period_start, s.start), q.period_end) + 1 AS at_risk_days, s.start > q.period_start AS first_partial, coalesce(c.n, 0) AS n, date_diff('month', date_trunc('quarter', s.start)::DATE, q.period_start) // 3 AS age
 FROM s JOIN q ON q.period_end >= s.start LEFT JOIN c ON c.o_custkey = s.o_custkey AND c.period_start = q.period_start)"""


def _quarters(first: str, last: str) -> list[tuple[str, str]]:
    """First and last day of each quarter, the quarters that begin on ``first`` and ``last`` included."""
    n = [int(d[:4]) * 4 + (int(d[5:7]) - 1) // 3 for d in (first, last)]
    return [(f"{k // 4}-{3 * (k % 4) + 1:02d}-01", f"{k // 4}-{3 * (k % 4) + 3:02d}-{(31, 30, 30, 31)[k % 4]}") for k in range(n[0], n[1] + 1)]


def _panel(spark: SparkSession, folder: str) -> DataFrame:
    periods = _quarters(*_span(spark, folder, "quarter", "1992-01-01", "1998-10-01"))
    orders = table(spark, folder, "orders")
    starts = orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("start"))
    counts = orders.groupBy("o_custkey", F.trunc("o_orderdate", "QUARTER").alias("period_start")).agg(F.count("*").alias("n"))
    panel = C.at_risk_panel(starts, "o_custkey", "start", periods).join(counts, ["o_custkey", "period_start"], "left").join(starts, "o_custkey")
    return panel.select("o_custkey", "period_start", "period_end", F.col("at_risk_days").cast("bigint").alias("at_risk_days"), "first_partial", F.coalesce("n", F.lit(0)).alias("n"), F.floor(C.calendar_months(F.trunc("start", "QUARTER"), F.col("period_start")) / 3).alias("age"))


@register(f"WITH {_PANEL} SELECT * FROM panel")
def risk_panel_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(spark, folder)


@register(f"WITH {_PANEL} SELECT CASE WHEN age < 4 THEN '0-3' WHEN age < 8 THEN '4-7' WHEN age < 16 THEN '8-15' ELSE '16+' END AS bin, count(*) AS rows_, sum(n)::BIGINT AS events FROM panel GROUP BY 1")
def age_bins(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("age")
    return _panel(spark, folder).groupBy(F.when(a < 4, "0-3").when(a < 8, "4-7").when(a < 16, "8-15").otherwise("16+").alias("bin")).agg(F.count("*").alias("rows_"), F.sum("n").alias("events"))


@register(f"WITH {_PANEL} SELECT o_custkey FROM panel GROUP BY 1 HAVING max((period_start < DATE '1995-07-01' AND NOT first_partial)::INT) = 1 AND max((period_start >= DATE '1995-07-01')::INT) = 1")
def eligible_both_sides(spark: SparkSession, folder: str) -> DataFrame:
    cut_ = F.lit("1995-07-01").cast("date")
    sides = _panel(spark, folder).groupBy("o_custkey").agg(F.max((F.col("period_start") < cut_) & ~F.col("first_partial")).alias("pre"), F.max(F.col("period_start") >= cut_).alias("post"))
    return sides.filter("pre and post").select("o_custkey")


@register(f"WITH {_PANEL} SELECT date_diff('month', DATE '1995-07-01', period_start) // 3 AS event_time, round(avg(n), 8) AS mean, count(*) AS rows_ FROM panel GROUP BY 1")
def event_time_means(spark: SparkSession, folder: str) -> DataFrame:
    t = F.floor(C.calendar_months(F.lit("1995-07-01").cast("date"), F.col("period_start")) / 3)
    return _panel(spark, folder).groupBy(t.alias("event_time")).agg(F.round(F.avg("n"), 8).alias("mean"), F.count("*").alias("rows_"))


@register(
    """WITH m AS (SELECT unnest(generate_series(DATE '1994-01-01', DATE '1997-12-01', INTERVAL 1 MONTH))::DATE AS month), t AS (SELECT month, row_number() OVER (ORDER BY month) AS time FROM m)
    SELECT month, time::INT AS time, (month >= DATE '1996-07-01')::INT AS post, (CASE WHEN month >= DATE '1996-07-01' THEN date_diff('month', DATE '1996-07-01', month) ELSE 0 END)::INT AS time_after, month(month)::INT AS month_of_year FROM t"""
)
def design_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Time from 1, the post flag, and time after the break, 0 in the break's month."""
    b = F.lit("1996-07-01").cast("date")
    m = C.spine(spark, "1994-01-01", "1997-12-01", "1 month", "month")
    return m.select("month", F.row_number().over(Window.orderBy("month")).alias("time"), (F.col("month") >= b).cast("int").alias("post"), F.when(F.col("month") >= b, C.calendar_months(b, F.col("month"))).otherwise(0).alias("time_after"), F.month("month").alias("month_of_year"))


_NEXT = """f AS (SELECT o_custkey, min(o_orderdate)::DATE AS start FROM orders GROUP BY 1), e AS (SELECT f.o_custkey, f.start, min(o.o_orderdate)::DATE AS event FROM f LEFT JOIN orders o ON o.o_custkey = f.o_custkey AND o.o_orderdate::DATE > f.start GROUP BY 1, 2)"""


def _second(spark: SparkSession, folder: str) -> DataFrame:
    """(o_custkey, start, event): each entity's first day and the next later one, by two aggregations of its distinct days."""
    days = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d")).distinct()
    first = days.groupBy("o_custkey").agg(F.min("d").alias("start"))
    return days.join(first, "o_custkey").groupBy("o_custkey", "start").agg(F.min(F.when(F.col("d") > F.col("start"), F.col("d"))).alias("event"))


def _last_day(spark: SparkSession, folder: str) -> Column:
    """The last day on which orders are seen: follow-up that hasn't ended by then is censored there. One aggregated row."""
    return F.lit(table(spark, folder, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]).cast("date")


@register(
    f"""WITH {_NEXT}, h AS (SELECT unnest([6, 12, 24]) AS months, (SELECT max(o_orderdate)::DATE FROM orders) AS last) SELECT months, count(*) FILTER ((start + to_months(months))::DATE <= greatest(DATE '1998-08-02', last)) AS eligible, count(*) FILTER ((start + to_months(months))::DATE <= greatest(DATE '1998-08-02', last) AND event <= (start + to_months(months))::DATE) AS inclusive,
    count(*) FILTER ((start + to_months(months))::DATE <= greatest(DATE '1998-08-02', last) AND event < (start + to_months(months))::DATE) AS exclusive FROM e, h GROUP BY months"""
)
def fixed_followup(spark: SparkSession, folder: str) -> DataFrame:
    """Events within fixed horizons among entities whose horizon ends by the censoring day; the horizon's last day in and out."""
    c = _last_day(spark, folder)
    until = lambda k: F.add_months("start", k)
    ok = lambda k: until(k) <= c
    one = _second(spark, folder).agg(*[x.alias(f"{n}{k}") for k in (6, 12, 24) for n, x in (("e", F.count_if(ok(k))), ("i", F.count_if(ok(k) & (F.col("event") <= until(k)))), ("x", F.count_if(ok(k) & (F.col("event") < until(k)))))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("months"), F.col(f"e{k}").alias("eligible"), F.col(f"i{k}").alias("inclusive"), F.col(f"x{k}").alias("exclusive")) for k in (6, 12, 24)])))


@register(
    f"""WITH {_NEXT}, d AS (SELECT date_diff('day', start, coalesce(event, greatest(DATE '1998-12-31', (SELECT max(o_orderdate)::DATE FROM orders)))) AS t, (event IS NOT NULL)::INT AS d FROM e), c AS (SELECT t, sum(d)::BIGINT AS events, count(*) AS leaving FROM d GROUP BY t),
    r AS (SELECT t, events, sum(leaving) OVER (ORDER BY t DESC)::BIGINT AS at_risk FROM c)
    SELECT t, at_risk, events, round(exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE -700 END) OVER (ORDER BY t)), 8) AS survival,
    round(sum(CASE WHEN events < at_risk THEN events / (at_risk::DOUBLE * (at_risk - events)) ELSE 0 END) OVER (ORDER BY t), 10) AS greenwood FROM r"""
)
def km_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Kaplan-Meier curve of the time to the next event; one row per day of follow-up, so the windows see a few thousand rows at most."""
    t = F.datediff(F.coalesce("event", _last_day(spark, folder)), F.col("start")).cast("bigint")
    c = _second(spark, folder).groupBy(t.alias("t")).agg(F.count("event").alias("events"), F.count("*").alias("leaving"))
    r = c.select("t", "events", F.sum("leaving").over(Window.orderBy(F.desc("t"))).alias("at_risk"))
    w, some = Window.orderBy("t"), F.col("events") < F.col("at_risk")
    return r.select(
        "t", "at_risk", "events", F.round(F.exp(F.sum(F.when(some, F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(-700.0)).over(w)), 8).alias("survival"),
        F.round(F.sum(F.when(some, F.col("events") / (F.col("at_risk").cast("double") * (F.col("at_risk") - F.col("events")))).otherwise(0.0)).over(w), 10).alias("greenwood"),
    )
