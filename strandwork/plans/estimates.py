"""Estimates that have a closed form, so that each estimator has a query that SQL computes from first principles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.models import linear as L
from strandwork.models import stats as S
from strandwork.plans.models import _END, _START, _series, two_by_two
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


def _p(z: str) -> str:
    """Two-sided p of a normal statistic: the error function's power series, which 120 terms settle up to 5 standard errors; 0 beyond."""
    x = f"(abs({z}) / sqrt(2.0))"
    terms = f"list_sum([CASE WHEN {x} = 0 THEN 0 ELSE (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1)) / (2 * k + 1) END FOR k IN range(0, 120)])"
    return f"CASE WHEN abs({z}) > 5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * {terms} END"


_TWO = """WITH d AS (SELECT o_custkey AS g, o_totalprice AS y, (o_orderpriority = '1-URGENT')::INT AS u, year(o_orderdate) AS v FROM orders),
m AS (SELECT avg(y) AS my, avg(u) AS mu, avg(v) AS mv, count(*) AS n FROM d),
s AS (SELECT sum((u - mu) ** 2) AS suu, sum((v - mv) ** 2) AS svv, sum((u - mu) * (v - mv)) AS suv, sum((u - mu) * (y - my)) AS suy, sum((v - mv) * (y - my)) AS svy FROM d, m),
b AS (SELECT (suy * svv - svy * suv) / (suu * svv - suv * suv) AS bu, (svy * suu - suy * suv) / (suu * svv - suv * suv) AS bv, suu, svv, suv, suu * svv - suv * suv AS det FROM s),
r AS (SELECT g, (y - my) - bu * (u - mu) - bv * (v - mv) AS e, ((u - mu) * svv - (v - mv) * suv) / det AS wu, ((v - mv) * suu - (u - mu) * suv) / det AS wv FROM d, m, b)"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_totalprice", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.year("o_orderdate").alias("year"))


def _terms(spark: SparkSession, fit: L.Fit, names: list[str]) -> DataFrame:
    rows = [(n, float(fit.beta[i]), float(fit.se[i])) for n in names for i in [fit.names.index(n)]]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double").select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"))


@register(f"{_TWO}, t AS (SELECT sqrt(sum(wu * wu * e * e) * n / (n - 3)) AS su, sqrt(sum(wv * wv * e * e) * n / (n - 3)) AS sv FROM r, m GROUP BY n) SELECT 'urgent' AS term, round(bu, 5) AS estimate, round(su, 5) AS std_error FROM b, t UNION ALL SELECT 'year', round(bv, 5), round(sv, 5) FROM b, t")
def ols_hc1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, L.ols(_orders(spark, folder), "o_totalprice", ["urgent", "year"]), ["urgent", "year"])


@register(f"{_TWO}, c AS (SELECT g, sum(wu * e) AS cu, sum(wv * e) AS cv FROM r GROUP BY g), t AS (SELECT sqrt(sum(cu * cu) * count(*) / (count(*) - 1) * (n - 1) / (n - 3)) AS su, sqrt(sum(cv * cv) * count(*) / (count(*) - 1) * (n - 1) / (n - 3)) AS sv FROM c, m GROUP BY n) SELECT 'urgent' AS term, round(bu, 5) AS estimate, round(su, 5) AS std_error FROM b, t UNION ALL SELECT 'year', round(bv, 5), round(sv, 5) FROM b, t")
def ols_cr1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, L.ols(_orders(spark, folder), "o_totalprice", ["urgent", "year"], cluster="o_custkey"), ["urgent", "year"])


@register("SELECT round(r2, 8) AS r2, round(r2 / (1 - r2) * (n - 2), 3) AS f_statistic, n FROM (SELECT regr_r2(o_totalprice, u) AS r2, count(*) AS n FROM (SELECT o_totalprice, year(o_orderdate) AS u FROM orders))")
def ols_f_statistic(spark: SparkSession, folder: str) -> DataFrame:
    fit = L.ols(_orders(spark, folder), "o_totalprice", ["year"], "classical")
    return spark.createDataFrame([(float(fit.extra["r2"]), fit.f_statistic(), fit.n)], "r2 double, f double, n bigint").select(F.round("r2", 8).alias("r2"), F.round("f", 3).alias("f_statistic"), "n")


_MONTHS = f"""WITH c AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY 1),
y AS (SELECT s.p, row_number() OVER (ORDER BY s.p)::DOUBLE AS t, coalesce(n, 0)::DOUBLE AS y FROM (SELECT unnest(generate_series(DATE '{_START}', DATE '{_END}', INTERVAL 1 MONTH))::DATE AS p) s LEFT JOIN c USING (p))"""


@register(
    f"""{_MONTHS}, f AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(t) AS mt, sum((t - (SELECT avg(t) FROM y)) ** 2) AS stt FROM y),
    w AS (SELECT t, (t - mt) / stt * (y - a - b * t) AS q FROM y, f), l AS (SELECT q, lag(q, 1) OVER (ORDER BY t) AS q1, lag(q, 2) OVER (ORDER BY t) AS q2, lag(q, 3) OVER (ORDER BY t) AS q3 FROM w)
    SELECT 'time' AS term, round(b, 5) AS estimate, round(se, 5) AS std_error, round({_p("b / se")}, 6) AS p_value FROM f, (SELECT sqrt(sum(q * q) + 2 * (0.75 * sum(q * q1) + 0.5 * sum(q * q2) + 0.25 * sum(q * q3))) AS se FROM l)"""
)
def trend_hac(spark: SparkSession, folder: str) -> DataFrame:
    """A trend with position-lagged errors (3) and its p-value."""
    y = L.series(_series(spark, folder), "period", ["treated"])[:, 0]
    fit = L.ols_hac(np.column_stack([np.ones(len(y)), np.arange(1, len(y) + 1)]), y, ["intercept", "time"], 3)
    p = S.normal_p(float(fit.beta[1]), float(fit.se[1]))
    return _terms(spark, fit, ["time"]).withColumn("p_value", F.round(F.lit(float(p)), 6))


@register(
    f"""{_MONTHS}, e AS (SELECT t, y - avg(y) OVER () AS e FROM y), l AS (SELECT e, lag(e, 1) OVER (ORDER BY t) AS e1, lag(e, 2) OVER (ORDER BY t) AS e2, lag(e, 3) OVER (ORDER BY t) AS e3 FROM e),
    r AS (SELECT sum(e * e1) / sum(e * e) AS a, sum(e * e2) / sum(e * e) AS b, sum(e * e3) / sum(e * e) AS c FROM l)
    SELECT unnest([1, 2, 3])::INT AS lag_, round(unnest([a, (b - a * a) / (1 - a * a), (a ** 3 - a * b * (2 - b) + c * (1 - a * a)) / ((1 - b) * (1 - 2 * a * a + b))]), 8) AS pacf FROM r"""
)
def partial_autocorrelations(spark: SparkSession, folder: str) -> DataFrame:
    y = L.series(_series(spark, folder), "period", ["treated"])[:, 0]
    rows = [(k, round(float(v), 8)) for k, v in enumerate(L.partial_autocorrelations(y, 3), 1)]
    return spark.createDataFrame(rows, "lag_ int, pacf double")


@register(
    """WITH d AS (SELECT l_suppkey AS a, l_orderkey AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem), q AS (SELECT g, a, y - avg(y) OVER (PARTITION BY a) AS y, x - avg(x) OVER (PARTITION BY a) AS x FROM d),
    f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM q), c AS (SELECT g, sum(x * (y - b * x)) AS s FROM q, f GROUP BY g)
    SELECT round(b, 4) AS estimate, round(sqrt(sum(s * s)) / sxx * sqrt(count(*) / (count(*) - 1) * (n - 1) / (n - 1)), 4) AS std_error FROM c, f GROUP BY b, sxx, n"""
)
def within_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Price on quantity within suppliers, errors clustered by order, which is another key."""
    fit = L.fixed_effects(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"], "l_orderkey")
    return spark.createDataFrame([(round(float(fit.beta[0]), 4), round(float(fit.se[0]), 4))], "estimate double, std_error double")


_FE = """WITH d AS (SELECT o_custkey AS g, o_orderpriority AS t, o_totalprice AS y, (o_orderstatus = 'F')::INT AS x FROM orders), c AS (SELECT g, t, avg(y) AS y, avg(x) AS x FROM d GROUP BY 1, 2), k AS (SELECT count(DISTINCT t) AS k FROM c), full_ AS (SELECT g FROM c, k GROUP BY g, k HAVING count(*) = k), p AS (SELECT c.* FROM c JOIN full_ USING (g)),
q AS (SELECT g, y - avg(y) OVER (PARTITION BY g) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y, x - avg(x) OVER (PARTITION BY g) - avg(x) OVER (PARTITION BY t) + avg(x) OVER () AS x FROM p),
f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n FROM q), s AS (SELECT g, sum(x * (y - b * x)) AS s FROM q, f GROUP BY g)"""


@register(f"{_FE} SELECT round(b, 4) AS estimate, round(sqrt(sum(s * s)) / sxx * sqrt(count(*) / (count(*) - 1)), 4) AS std_error, n FROM s, f GROUP BY b, sxx, n")
def two_way_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """Two-way fixed effects of customers and priorities on the customers that have all of them, where the means have a closed form."""
    cells = table(spark, folder, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("y"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("x"))
    kinds = cells.select("o_orderpriority").distinct().count()
    whole = cells.groupBy("o_custkey").agg(F.count("*").alias("k")).filter(F.col("k") == kinds).select("o_custkey")
    fit = L.fixed_effects(cells.join(whole, "o_custkey"), "y", ["x"], ["o_custkey", "o_orderpriority"], "o_custkey")
    return spark.createDataFrame([(round(float(fit.beta[0]), 4), round(float(fit.se[0]), 4), fit.n)], "estimate double, std_error double, n bigint")


@register(
    """WITH c AS (SELECT o_custkey, count(*) AS y, max((o_orderpriority = '1-URGENT')::INT) AS x FROM orders GROUP BY 1), m AS (SELECT avg(y) FILTER (x = 1) AS m1, avg(y) FILTER (x = 0) AS m0, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0 FROM c),
    v AS (SELECT sum((y - m1) ** 2) FILTER (x = 1) AS v1, sum((y - m0) ** 2) FILTER (x = 0) AS v0 FROM c, m)
    SELECT round(ln(m1 / m0), 7) AS estimate, round(sqrt(v1 / (n1 * m1) ** 2 + v0 / (n0 * m0) ** 2), 7) AS std_error, round((v1 / m1 + v0 / m0) / (n1 + n0 - 2), 6) AS dispersion FROM m, v"""
)
def poisson_two_groups(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("x"))
    fit = L.newton(counts, "y", ["x"], "poisson")
    return spark.createDataFrame([(round(float(fit.beta[1]), 7), round(float(fit.se[1]), 7), round(fit.extra["dispersion"], 6))], "estimate double, std_error double, dispersion double")


@register("SELECT round(ln((a * d)::DOUBLE / (b * c)), 7) AS estimate, round(sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d), 7) AS std_error FROM (SELECT count(*) FILTER (x AND y) AS a, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (NOT x AND y) AS c, count(*) FILTER (NOT x AND NOT y) AS d FROM (SELECT l_discount > 0.05 AS x, l_returnflag = 'R' AS y FROM lineitem))")
def logit_two_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("x"))
    fit = L.newton(rows, "y", ["x"], "logit")
    return spark.createDataFrame([(round(float(fit.beta[1]), 7), round(float(fit.se[1]), 7))], "estimate double, std_error double")


@register(
    """WITH t AS (SELECT count(*) FILTER (t AND h) AS a, count(*) FILTER (t AND NOT h) AS b, count(*) FILTER (NOT t AND h) AS c, count(*) FILTER (NOT t AND NOT h) AS d FROM (SELECT c_mktsegment = 'BUILDING' AS t, c_acctbal < 0 AS h FROM customer)),
    k AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS k FROM t),
    p AS (SELECT a, k, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - (a + c - k) + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM k)
    SELECT round(least(1, sum(p) FILTER (p <= (SELECT p FROM p WHERE k = a) * (1 + 1e-9))), 7) AS p_value FROM p"""
)
def fisher_p(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(round(S.fisher_two_sided(*two_by_two(spark, folder).first()), 7),)], "p_value double")


@register(
    """WITH c AS (SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS p FROM orders GROUP BY 1)
    SELECT arm, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)), 8) AS low, round(least(1, p + 1.96 * sqrt(p * (1 - p) / n)), 8) AS high FROM c"""
)
def wald_ci(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("events"))
    low, high = S.wald(F.col("events"), F.col("n"))
    return c.select("arm", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


_ARMS = """WITH c AS (SELECT o_orderpriority AS arm, count(*) FILTER (post) AS n1, count(*) FILTER (post AND hit) AS e1, count(*) FILTER (NOT post) AS n0, count(*) FILTER (NOT post AND hit) AS e0 FROM (SELECT o_orderpriority, o_orderdate >= TIMESTAMP '1998-01-01' AS post, o_orderstatus = 'F' AS hit FROM orders) GROUP BY 1),
z AS (SELECT arm, (e1 / n1 - e0 / n0) / sqrt((e1 + e0) / (n1 + n0) * (1 - (e1 + e0) / (n1 + n0)) * (1.0 / n1 + 1.0 / n0)) AS z FROM c)"""


@register(f"{_ARMS} SELECT arm, round(z, 6) AS z, round({_p('z')}, 7) AS p_value FROM z")
def two_proportions_p(spark: SparkSession, folder: str) -> DataFrame:
    """The two-proportion test of each arm with its p-value."""
    post, hit = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), F.col("o_orderstatus") == "F"
    c = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count_if(post).alias("n1"), F.count_if(post & hit).alias("e1"), F.count_if(~post).alias("n0"), F.count_if(~post & hit).alias("e0")).collect()  # a row per arm
    rows = [(r["arm"], *S.two_proportions(r["e1"], r["n1"], r["e0"], r["n0"])) for r in c]
    out = spark.createDataFrame(rows, "arm string, z double, p double")
    return out.select("arm", F.round("z", 6).alias("z"), F.round(F.when(F.abs("z") > 5, 0.0).otherwise(F.col("p")), 7).alias("p_value"))


_CELLS = """WITH o AS (SELECT c_mktsegment AS part, (o_orderpriority = '1-URGENT')::INT AS arm, (o_orderdate >= TIMESTAMP '1998-07-01')::INT AS post, o_totalprice AS y FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT part, arm, post, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM o GROUP BY 1, 2, 3 UNION ALL SELECT 'all', arm, post, count(*), avg(y), var_samp(y) FROM o GROUP BY 2, 3),
d AS (SELECT part, sum(m * (2 * arm - 1) * (2 * post - 1)) AS did, sqrt(sum(v / n)) AS se FROM g GROUP BY part HAVING count(*) = 4)"""


@register(f"{_CELLS} SELECT d.part, round(d.did, 4) AS did, round(d.se, 4) AS se, round((d.did - a.did) / d.se, 6) AS distance, (abs(d.did - a.did) / d.se > 1.96) AS differs FROM d, d a WHERE a.part = 'all'")
def did_battery(spark: SparkSession, folder: str) -> DataFrame:
    """Difference in differences overall and per part, and whether a part is so far from the whole that effects aren't alike."""
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("part")), "o_custkey")
    sign = F.when((F.col("o_orderpriority") == "1-URGENT") == (F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")), 1).otherwise(-1)
    cells = orders.withColumn("arm", F.col("o_orderpriority") == "1-URGENT").withColumn("sign", sign).groupBy("part", "arm", "sign").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.sum(F.col("o_totalprice") ** 2).alias("q"))
    # the whole is the sum of its parts' sums: the orders are read once
    both = cells.unionByName(cells.withColumn("part", F.lit("all"))).groupBy("part", "arm", "sign").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    did = both.groupBy("part").agg(F.sum(mean * F.col("sign")).alias("did"), F.sqrt(F.sum((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1) / F.col("n"))).alias("se"), F.count("*").alias("k")).filter("k = 4")
    overall = F.max(F.when(F.col("part") == "all", F.col("did"))).over(Window.partitionBy())  # a row per part
    far = did.withColumn("far", (F.col("did") - overall) / F.col("se"))
    return far.select("part", F.round("did", 4).alias("did"), F.round("se", 4).alias("se"), F.round("far", 6).alias("distance"), (F.abs("far") > 1.96).alias("differs"))


_BREAKS = ["1996-01-01", "1996-07-01", "1997-01-01", "1997-07-01", "1998-01-01", "1998-07-01"]


@register(
    f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS p, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT unnest({_BREAKS!r})::DATE AS break_)
    SELECT break_, round(avg(n) FILTER (p >= break_) - avg(n) FILTER (p < break_), 6) AS difference, rank() OVER (ORDER BY abs(avg(n) FILTER (p >= break_) - avg(n) FILTER (p < break_)) DESC, break_)::INT AS place FROM b JOIN m ON p >= break_ - INTERVAL 6 MONTH AND p < break_ + INTERVAL 6 MONTH GROUP BY break_"""
)
def matched_window_placebos(spark: SparkSession, folder: str) -> DataFrame:
    """Six months after against six before, at breaks that never were and the one that was, by the size of the difference."""
    monthly = table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("p")).agg(F.count("*").alias("n"))
    near = F.filter(F.array(*[F.lit(b).cast("date") for b in _BREAKS]), lambda b: (F.col("p") >= F.add_months(b, -6)) & (F.col("p") < F.add_months(b, 6)))
    by = monthly.select("p", "n", F.explode(near).alias("break_")).groupBy("break_").agg((F.avg(F.when(F.col("p") >= F.col("break_"), F.col("n"))) - F.avg(F.when(F.col("p") < F.col("break_"), F.col("n")))).alias("d"))
    return by.select("break_", F.round("d", 6).alias("difference"), F.rank().over(Window.orderBy(F.desc(F.abs("d")), "break_")).alias("place"))


@register(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS arm, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT month, arm, sum(n - a) OVER (PARTITION BY arm ORDER BY month) AS gap FROM (SELECT *, avg(n) OVER (PARTITION BY arm) AS a FROM m)),
    l AS (SELECT month, arm, gap, min(gap) OVER (PARTITION BY arm ORDER BY month) AS low FROM g) SELECT arm, min(month) FILTER (low < -5) AS first_crossing, round(min(low), 6) AS lowest FROM l GROUP BY arm"""
)
def first_crossing(spark: SparkSession, folder: str) -> DataFrame:
    """The first month in which an arm's running minimum of its cumulative gap goes below a bound; null where it never does."""
    m = table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"))
    run = Window.partitionBy("arm").orderBy("month")
    gap = m.withColumn("a", F.avg("n").over(Window.partitionBy("arm"))).withColumn("gap", F.sum(F.col("n") - F.col("a")).over(run))
    low = gap.withColumn("low", F.min("gap").over(run))
    return low.groupBy("arm").agg(F.min(F.when(F.col("low") < -5, F.col("month"))).alias("first_crossing"), F.round(F.min("low"), 6).alias("lowest"))
