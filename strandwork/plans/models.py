"""Queries of sums behind estimators, and of the estimators themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.models import linear as L
from strandwork.models import stats as S
from strandwork.operators import calendar as C
from strandwork.operators.ordered import exact_quantiles
from strandwork.plans.calendar import _panel
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_START, _END, _BREAK = "1995-01-01", "2001-12-01", "1998-07-01"


@register(
    "SELECT count(*) AS n, round(sum(l_quantity), 4) AS sx, round(sum(l_quantity * l_quantity), 4) AS sxx, round(sum(l_quantity * l_extendedprice), 2) AS sxy, round(sum(l_quantity * l_discount), 6) AS sxd, round(sum(l_discount * l_discount), 6) AS sdd, round(sum(l_discount * l_extendedprice), 4) AS sdy FROM lineitem"
)
def gram_matrix(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select(F.lit(1.0).alias("one"), "l_quantity", "l_discount", "l_extendedprice")
    g, n = L.moments(li, ["one", "l_quantity", "l_discount", "l_extendedprice"])
    return spark.createDataFrame([(n, *(round(float(g[i, j]), d) for i, j, d in ((0, 1, 4), (1, 1, 4), (1, 3, 2), (1, 2, 6), (2, 2, 6), (2, 3, 4))))], "n bigint, sx double, sxx double, sxy double, sxd double, sdd double, sdy double")


@register("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def ols_simple(spark: SparkSession, folder: str) -> DataFrame:
    fit = L.ols(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"], "classical")
    return spark.createDataFrame([(round(float(fit.beta[0]), 4), round(float(fit.beta[1]), 6), round(float(fit.extra["r2"]), 8), fit.n)], "intercept double, slope double, r2 double, n bigint")


@register()
def ols_robust(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_totalprice", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.year("o_orderdate").alias("year"))
    fits = {"hc1": L.ols(orders, "o_totalprice", ["urgent", "year"]), "cluster": L.ols(orders, "o_totalprice", ["urgent", "year"], cluster="o_custkey")}
    return L.results(spark, fits)


def _series(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("period")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("treated"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("control"))
    return C.gap_filled(C.spine(spark, _START, _END), counts, "period", ["treated", "control"])


def _positions() -> int:
    return (int(_BREAK[:4]) - int(_START[:4])) * 12 + int(_BREAK[5:7]) - int(_START[5:7])


@register()
def its_ols_hac(spark: SparkSession, folder: str) -> DataFrame:
    """Segmented regressions of both arms and their difference with position-lagged errors (3)."""
    y = L.series(_series(spark, folder), "period", ["treated", "control"])
    x, names = L.its_design(len(y), _positions())
    return L.results(spark, {"treated": L.ols_hac(x, y[:, 0], names, 3), "control": L.ols_hac(x, y[:, 1], names, 3), "difference": L.ols_hac(x, y[:, 0] - y[:, 1], names, 3)})


@register()
def its_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    """Error lags, an autoregressive fit, other ends and a transition left out: one model each."""
    y = L.series(_series(spark, folder), "period", ["treated", "control"])
    d, at = y[:, 0] - y[:, 1], _positions()
    x, names = L.its_design(len(d), at)
    fits = {f"lag{k}": L.ols_hac(x, d, names, k) for k in (1, 3, 6, 12)} | {"auto": L.ols_hac(x, d, names), "ar1": L.prais_winsten(x, d, names)}
    for cut_ in (6, 12):
        fits[f"end-{cut_}"] = L.ols_hac(x[:-cut_], d[:-cut_], names, 3)
    keep = np.array([not at <= i < at + 3 for i in range(len(d))])
    fits["transition"] = L.ols_hac(L.its_design(int(keep.sum()), at)[0], d[keep], names, 3)
    return L.results(spark, fits)


@register()
def its_placebo(spark: SparkSession, folder: str) -> DataFrame:
    """Breaks that never were, before the real one, with step-down adjusted p-values."""
    from strandwork.operators.ordered import holm

    y = L.series(_series(spark, folder), "period", ["treated", "control"])
    d, at = (y[:, 0] - y[:, 1])[: _positions()], _positions()
    fits = {f"break{k:02d}": L.ols_hac(L.its_design(at, k)[0], d, ["intercept", "time", "post", "time_after"], 3) for k in range(12, at - 6, 3)}
    tests = L.results(spark, fits).filter("term = 'post'").withColumn("family", F.lit("placebo"))
    return holm(tests, ["family"], "p_value", "model").drop("family")


@register()
def its_expected_path(spark: SparkSession, folder: str) -> DataFrame:
    """The pre-break fit carried forward: expected, prediction error, gap and cumulative gap with its error."""
    y = L.series(_series(spark, folder), "period", ["treated"])[:, 0]
    at = _positions()
    x = np.column_stack([np.ones(len(y)), np.arange(1, len(y) + 1)])
    fit = L.ols_hac(x[:at], y[:at], ["intercept", "time"], 3)
    rows, total, weights = [], 0.0, np.zeros(2)
    for i in range(at, len(y)):
        expected, se = float(x[i] @ fit.beta), float(np.sqrt(x[i] @ fit.cov @ x[i]))
        total, weights = total + float(y[i]) - expected, weights + x[i]
        rows.append((i - at, float(y[i]), expected, se, float(y[i] - expected), total, float(np.sqrt(weights @ fit.cov @ weights))))
    return spark.createDataFrame(rows, "position int, observed double, expected double, se double, gap double, cumulative double, cumulative_se double")


@register(
    f"""WITH m AS (SELECT s.period, count(o.o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS y FROM (SELECT unnest(generate_series(DATE '{_START}', DATE '{_END}', INTERVAL 1 MONTH))::DATE AS period) s LEFT JOIN orders o ON date_trunc('month', o_orderdate)::DATE = s.period GROUP BY 1),
    e AS (SELECT period, y - avg(y) OVER () AS e FROM m), l AS (SELECT e, lag(e, 1) OVER (ORDER BY period) AS e1, lag(e, 2) OVER (ORDER BY period) AS e2, lag(e, 3) OVER (ORDER BY period) AS e3 FROM e)
    SELECT round(sum(e * e), 6) AS g0, round(sum(e * e1), 6) AS g1, round(sum(e * e2), 6) AS g2, round(sum(e * e3), 6) AS g3, round(sum(e * e) + 2 * (0.75 * sum(e * e1) + 0.5 * sum(e * e2) + 0.25 * sum(e * e3)), 6) AS meat,
    round(sum((e - e1) * (e - e1)) / sum(e * e), 8) AS durbin_watson, round(sum(e * e1) / sum(e * e), 8) AS acf1 FROM l"""
)
def hac_meat_terms(spark: SparkSession, folder: str) -> DataFrame:
    e = _series(spark, folder).select("period", (F.col("treated") - F.avg("treated").over(Window.partitionBy())).alias("e"))
    w = Window.orderBy("period")
    lagged = e.select("e", *[F.lag("e", k).over(w).alias(f"e{k}") for k in (1, 2, 3)])
    g = [F.sum(F.col("e") * F.col("e"))] + [F.sum(F.col("e") * F.col(f"e{k}")) for k in (1, 2, 3)]
    meat = g[0] + 2 * (0.75 * g[1] + 0.5 * g[2] + 0.25 * g[3])
    return lagged.agg(*[F.round(x, 6).alias(f"g{k}") for k, x in enumerate(g)], F.round(meat, 6).alias("meat"), F.round(F.sum((F.col("e") - F.col("e1")) ** 2) / g[0], 8).alias("durbin_watson"), F.round(g[1] / g[0], 8).alias("acf1"))


@register(
    """WITH b AS (SELECT regr_intercept(o_totalprice, u) AS a, regr_slope(o_totalprice, u) AS b FROM (SELECT o_totalprice, (o_orderpriority = '1-URGENT')::INT AS u FROM orders)), s AS (SELECT o_custkey, sum(o_totalprice - a - b * u) AS s0, sum(u * (o_totalprice - a - b * u)) AS s1 FROM (SELECT *, (o_orderpriority = '1-URGENT')::INT AS u FROM orders), b GROUP BY 1)
    SELECT count(*) AS clusters, round(sum(s0 * s0) / 1e6, 2) AS m00, round(sum(s0 * s1) / 1e6, 2) AS m01, round(sum(s1 * s1) / 1e6, 2) AS m11 FROM s"""
)
def cluster_score_outer(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("u"))
    fit = L.ols(orders, "o_totalprice", ["u"])
    e = F.col("o_totalprice") - float(fit.beta[0]) - float(fit.beta[1]) * F.col("u")
    s = orders.groupBy("o_custkey").agg(F.sum(e).alias("s0"), F.sum(F.col("u") * e).alias("s1"))
    part = lambda a, b: F.round(F.sum(F.col(a) * F.col(b)) / 1e6, 2)
    return s.agg(F.count("*").alias("clusters"), part("s0", "s0").alias("m00"), part("s0", "s1").alias("m01"), part("s1", "s1").alias("m11"))


@register()
def autocorrelation(spark: SparkSession, folder: str) -> DataFrame:
    y = L.series(_series(spark, folder), "period", ["treated"])[:, 0]
    x, names = L.its_design(len(y), _positions())
    e = L.ols_hac(x, y, names, 3).extra["resid"]
    q, p = L.ljung_box(e, 12)
    rows = [(f"acf{k}", float(v)) for k, v in enumerate(L.autocorrelations(e, 12), 1)] + [("durbin_watson", L.durbin_watson(e)), ("ljung_box", q), ("ljung_box_p", p)]
    return spark.createDataFrame(rows, "name string, value double")


@register()
def fe_did_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """Two-way fixed effects of customers and quarters with errors clustered by customer."""
    panel = _panel(spark, folder).join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("arm")), "o_custkey")
    panel = panel.filter("period_start >= '1995-01-01'").withColumn("treated_post", F.col("arm") * (F.col("period_start") >= "1997-01-01").cast("int")).withColumn("young", (F.col("age") < 4).cast("int"))
    return L.results(spark, {"did": L.fixed_effects(panel, "n", ["treated_post", "young"], ["o_custkey", "period_start"], "o_custkey")})


@register()
def event_study(spark: SparkSession, folder: str) -> DataFrame:
    """Treated by quarters to the break, the last one before it as reference, and the joint test of those before."""
    panel = _panel(spark, folder).join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("arm")), "o_custkey")
    k = F.floor(C.calendar_months(F.lit("1997-01-01").cast("date"), F.col("period_start")) / 3)
    panel = panel.withColumn("k", k).filter("k between -4 and 3")
    terms = {f"k{j}".replace("-", "m"): j for j in range(-4, 4) if j != -1}
    panel = panel.withColumns({t: F.col("arm") * (F.col("k") == j).cast("int") for t, j in terms.items()})
    fit = L.fixed_effects(panel, "n", list(terms), ["o_custkey", "period_start"], "o_custkey")
    w, df, p = fit.wald([t for t, j in terms.items() if j < 0])
    return L.results(spark, {"event study": fit}).unionAll(spark.createDataFrame([("pre-trend", f"wald({df})", w, None, None, p, None, None, fit.n)], L.RESULT))


@register()
def poisson_qmle(spark: SparkSession, folder: str) -> DataFrame:
    panel = _panel(spark, folder).select("n", (F.col("period_start") >= "1997-01-01").cast("int").alias("post"), F.least("age", F.lit(8)).alias("age"), F.log("at_risk_days").alias("exposure"))
    fit = L.newton(panel, "n", ["post", "age"], "poisson", offset="exposure")
    return L.results(spark, {"poisson": fit})


@register()
def logit_newton(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.floor(F.col("l_quantity") / 10).alias("size"), (F.col("l_discount") > 0.05).cast("int").alias("discounted"))
    return L.results(spark, {"logit": L.newton(rows, "y", ["size", "discounted"], "logit")})


@register(
    """WITH c AS (SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS events FROM orders GROUP BY 1), p AS (SELECT *, events / n AS p FROM c)
    SELECT arm, n, events, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 8) AS low, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 8) AS high FROM p"""
)
def wilson_ci(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("events"))
    low, high = S.wilson(F.col("events"), F.col("n"))
    return c.select("arm", "n", "events", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@register(
    """WITH c AS (SELECT count(*) FILTER (post) AS n1, count(*) FILTER (post AND hit) AS e1, count(*) FILTER (NOT post) AS n0, count(*) FILTER (NOT post AND hit) AS e0 FROM (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS post, o_orderpriority = '1-URGENT' AS hit FROM orders)), p AS (SELECT *, e1 / n1 AS p1, e0 / n0 AS p0, (e1 + e0) / (n1 + n0) AS pp FROM c)
    SELECT n1, e1, n0, e0, round(p1 - p0, 8) AS difference, round(sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 8) AS se, round((p1 - p0) / sqrt(pp * (1 - pp) * (1.0 / n1 + 1.0 / n0)), 6) AS z, round(p1 / p0, 8) AS ratio FROM p"""
)
def prop_diff(spark: SparkSession, folder: str) -> DataFrame:
    post, hit = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp"), F.col("o_orderpriority") == "1-URGENT"
    c = table(spark, folder, "orders").agg(F.count_if(post).alias("n1"), F.count_if(post & hit).alias("e1"), F.count_if(~post).alias("n0"), F.count_if(~post & hit).alias("e0"))
    p = c.select("*", (F.col("e1") / F.col("n1")).alias("p1"), (F.col("e0") / F.col("n0")).alias("p0"), ((F.col("e1") + F.col("e0")) / (F.col("n1") + F.col("n0"))).alias("pp"))
    se = F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p0") * (1 - F.col("p0")) / F.col("n0"))
    z = (F.col("p1") - F.col("p0")) / F.sqrt(F.col("pp") * (1 - F.col("pp")) * (1 / F.col("n1") + 1 / F.col("n0")))
    return p.select("n1", "e1", "n0", "e0", F.round(F.col("p1") - F.col("p0"), 8).alias("difference"), F.round(se, 8).alias("se"), F.round(z, 6).alias("z"), F.round(F.col("p1") / F.col("p0"), 8).alias("ratio"))


@register(
    """SELECT count(*) FILTER (t AND h) AS a, count(*) FILTER (t AND NOT h) AS b, count(*) FILTER (NOT t AND h) AS c, count(*) FILTER (NOT t AND NOT h) AS d FROM (SELECT c_mktsegment = 'BUILDING' AS t, c_acctbal < 0 AS h FROM customer)"""
)
def two_by_two(spark: SparkSession, folder: str) -> DataFrame:
    t, h = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") < 0
    return table(spark, folder, "customer").agg(F.count_if(t & h).alias("a"), F.count_if(t & ~h).alias("b"), F.count_if(~t & h).alias("c"), F.count_if(~t & ~h).alias("d"))


@register()
def fisher_exact(spark: SparkSession, folder: str) -> DataFrame:
    cells = tuple(two_by_two(spark, folder).first())
    return spark.createDataFrame([(*cells, S.fisher_two_sided(*cells))], "a bigint, b bigint, c bigint, d bigint, p_value double")


@register()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    """Percentile interval of the mean order value, customers drawn as wholes."""
    per = table(spark, folder, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    means = L.cluster_bootstrap(per, "o_custkey", lambda d: [(F.sum(d.w * d.s) / F.sum(d.w * d.n)).alias("mean")])
    return exact_quantiles(means, "mean", [0.025, 0.5, 0.975]).select("q", "n", "quantile")


@register(
    f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) FILTER (o_orderpriority = '1-URGENT') AS t, count(*) FILTER (o_orderpriority = '5-LOW') AS c FROM orders GROUP BY 1)
    SELECT period, abs((t - c) - (t::DOUBLE - c::DOUBLE)) < 2e-7 AS holds FROM m WHERE period BETWEEN DATE '{_START}' AND DATE '{_END}'"""
)
def decomposition_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Treated minus control against a difference counted on its own."""
    month = F.trunc("o_orderdate", "MM").alias("period")
    signed = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(0)
    apart = table(spark, folder, "orders").groupBy(month).agg(F.sum(signed).alias("difference"), F.count("*").alias("n"))
    both = _series(spark, folder).join(apart, "period")
    return both.select("period", (F.abs(F.col("treated") - F.col("control") - F.col("difference")) < 2e-7).alias("holds"))
