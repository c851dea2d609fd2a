"""Queries of counts, shares, quantiles, roll-ups and ordered series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.operators.aggregate import coverage, fractional_weights, unique_joined
from strandwork.operators.ordered import exact_quantiles, holm
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_STATUS = ["live", "disabled", "removed", "404", "unknown"]


@register(
    f"""SELECT s AS status, count(r.repo_row_id) AS n FROM (SELECT unnest({_STATUS!r}) AS s) d LEFT JOIN ukb_dmca_repositories r ON coalesce(nullif(lower(trim(repo_status)), ''), 'unknown') = d.s GROUP BY s"""
)
def counts_fixed_keys(spark: SparkSession, folder: str) -> DataFrame:
    status = F.coalesce(F.nullif(F.lower(F.trim("repo_status")), F.lit("")), F.lit("unknown"))
    counts = table(spark, folder, "ukb_dmca_repositories").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    return spark.createDataFrame([(s,) for s in _STATUS], "status string").join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@register("SELECT label, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(alleged_data_type, ';')))) AS label FROM ukb_dmca_repositories) WHERE label <> '' GROUP BY label")
def multi_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ukb_dmca_repositories").select(F.explode(F.split("alleged_data_type", ";")).alias("x")).select(F.lower(F.trim("x")).alias("label")).filter("label <> ''").groupBy("label").agg(F.count("*").alias("n"))


@register(
    """SELECT coalesce(CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 'pre' ELSE 'post' END, 'x') AS period, l_returnflag, count(*) AS n, sum((l_discount > 0.05)::INT)::BIGINT AS discounted FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT 'all', l_returnflag, count(*), sum((l_discount > 0.05)::INT)::BIGINT FROM lineitem GROUP BY 2"""
)
def flag_counts_by_period(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_returnflag", F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"), "pre").otherwise("post").alias("period"), (F.col("l_discount") > 0.05).cast("int").alias("d"))
    # the finer counts are made once; the totals come from them
    fine = rows.groupBy("l_returnflag", "period").agg(F.count("*").alias("n"), F.sum("d").alias("discounted"))
    return fine.rollup("l_returnflag", "period").agg(F.sum("n").alias("n"), F.sum("discounted").alias("discounted")).filter("l_returnflag is not null").select(F.coalesce("period", F.lit("all")).alias("period"), "l_returnflag", "n", "discounted")


@register("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY o_orderpriority")
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    # distinct first on (key, value): a hot priority is spread over its customers
    pairs = table(spark, folder, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("c"))
    return pairs.groupBy("o_orderpriority").agg(F.count("*").alias("customers"), F.sum("c").alias("orders"))


@register(
    """WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), w AS (SELECT l_partkey, l_suppkey, 1.0 / count(*) OVER (PARTITION BY l_partkey) AS weight FROM p)
    SELECT l_suppkey, round(sum(weight), 6) AS fractional_parts, count(*) AS parts FROM w GROUP BY l_suppkey"""
)
def fractional_attribution(spark: SparkSession, folder: str) -> DataFrame:
    weights = fractional_weights(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "weight")
    return weights.groupBy("l_suppkey").agg(F.round(F.sum("weight"), 6).alias("fractional_parts"), F.count("*").alias("parts"))


@register(
    """SELECT o_custkey, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first_order, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_order FROM orders GROUP BY o_custkey"""
)
def first_and_last(spark: SparkSession, folder: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"), F.min_by("o_orderkey", order).alias("first_order"), F.max_by("o_orderkey", order).alias("last_order"))


@register(
    """WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY k) AS priorities, count(*) AS n FROM f GROUP BY o_custkey"""
)
def unique_in_order(spark: SparkSession, folder: str) -> DataFrame:
    return unique_joined(table(spark, folder, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", "priorities")


@register("SELECT n_regionkey, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def sorted_unique(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), "|").alias("nations"))


_LINEAGE = "upper(trim(lineage_id))"
# Words that stand for an id that isn't known.
_UNKNOWN = ("", "unresolved", "tbd", "unknown", "n/a", "na", "nan", "none", "null", "-")
_NOT_KNOWN = ", ".join(f"'{w}'" for w in _UNKNOWN)


@register(
    f"""SELECT {_LINEAGE} AS lineage, count(*) AS rows_, count(DISTINCT lower(repo_owner || '/' || repo_name)) AS repos, count(DISTINCT notice_id) AS notices, min(notice_date) AS first_notice, max(notice_date) AS last_notice,
    sum(wayback_capture_count)::BIGINT AS captures, sum((lower(trim(repo_status)) = 'disabled')::INT)::BIGINT AS disabled FROM ukb_dmca_repositories WHERE lower(trim(lineage_id)) NOT IN ({_NOT_KNOWN}) GROUP BY 1"""
)
def entity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ukb_dmca_repositories").filter(~F.lower(F.trim("lineage_id")).isin(*_UNKNOWN))
    return rows.groupBy(F.upper(F.trim("lineage_id")).alias("lineage")).agg(
        F.count("*").alias("rows_"), F.count_distinct(F.lower(F.concat("repo_owner", F.lit("/"), "repo_name"))).alias("repos"), F.count_distinct("notice_id").alias("notices"),
        F.min("notice_date").alias("first_notice"), F.max("notice_date").alias("last_notice"), F.sum(F.col("wayback_capture_count").cast("bigint")).alias("captures"), F.sum((F.lower(F.trim("repo_status")) == "disabled").cast("int")).alias("disabled"),
    )


@register(
    """SELECT lower(repo_name) AS family, count(*) AS rows_, count(*) FILTER (lower(trim(repo_status)) = 'live') AS live, count(*) FILTER (lower(trim(repo_status)) IN ('removed', '404')) AS gone, count(DISTINCT lower(repo_owner)) AS owners FROM ukb_dmca_repositories GROUP BY 1"""
)
def family_rollup(spark: SparkSession, folder: str) -> DataFrame:
    status = F.lower(F.trim("repo_status"))
    return table(spark, folder, "ukb_dmca_repositories").groupBy(F.lower("repo_name").alias("family")).agg(F.count("*").alias("rows_"), F.count_if(status == "live").alias("live"), F.count_if(status.isin("removed", "404")).alias("gone"), F.count_distinct(F.lower("repo_owner")).alias("owners"))


@register(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS high,
    round(avg((value < 1)::INT), 6) AS below_one FROM events GROUP BY event_type"""
)
def summary_statistics(spark: SparkSession, folder: str) -> DataFrame:
    se = F.stddev_samp("value") / F.sqrt(F.count("value"))
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(se, 6).alias("se"), F.round(F.avg("value") - 1.96 * se, 6).alias("low"), F.round(F.avg("value") + 1.96 * se, 6).alias("high"), F.round(F.avg((F.col("value") < 1).cast("int")), 6).alias("below_one"))


@register(
    """SELECT o_orderpriority, q, n, round(quantile_cont(o_totalprice, 0.25), 6) AS quantile FROM (SELECT o_orderpriority, o_totalprice, 0.25::DOUBLE AS q, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY ALL
    UNION ALL SELECT o_orderpriority, 0.5::DOUBLE, count(*), round(quantile_cont(o_totalprice, 0.5), 6) FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 0.975::DOUBLE, count(*), round(quantile_cont(o_totalprice, 0.975), 6) FROM orders GROUP BY 1"""
)
def quantiles_by_group(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_quantiles(table(spark, folder, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", [0.25, 0.5, 0.975], ["o_orderpriority"])
    return found.select("o_orderpriority", "q", "n", F.round("quantile", 6).alias("quantile"))


@register("SELECT round(median(l_extendedprice), 6) AS median, (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET (SELECT count(*) // 2 FROM lineitem)) AS upper_median FROM lineitem")
def medians(spark: SparkSession, folder: str) -> DataFrame:
    """The true median, and the upper one (the value in place n div 2 from 0)."""
    half = exact_quantiles(table(spark, folder, "lineitem").select("l_extendedprice"), "l_extendedprice", [0.5])
    return half.select(F.round("quantile", 6).alias("median"), F.col("upper").alias("upper_median"))


@register(
    """WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT quantile_cont(n, 0.99) AS q FROM t) SELECT o_custkey, n FROM t, q WHERE n >= q AND n > 0"""
)
def top_one_percent(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    threshold = exact_quantiles(totals, "n", [0.99]).select("quantile")  # one row
    return totals.join(F.broadcast(threshold), F.col("n") >= F.col("quantile")).filter("n > 0").select("o_custkey", "n")


@register(
    """WITH c AS (SELECT s_nationkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey), t AS (SELECT n_name, count(*) AS n FROM c GROUP BY 1), s AS (SELECT n_name, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, n_name) AS r FROM t)
    SELECT round(sum(share * share), 8) AS hhi, round(sum(share) FILTER (r <= 1), 8) AS top1, round(sum(share) FILTER (r <= 5), 8) AS top5, count(*) AS groups FROM s"""
)
def concentration(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    counts = named.groupBy("n_name").agg(F.count("*").alias("n"))
    shares = counts.select("n_name", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.row_number().over(Window.orderBy(F.col("n").desc(), "n_name")).alias("r"))
    return shares.agg(F.round(F.sum(F.col("share") * F.col("share")), 8).alias("hhi"), F.round(F.sum(F.when(F.col("r") <= 1, F.col("share"))), 8).alias("top1"), F.round(F.sum(F.when(F.col("r") <= 5, F.col("share"))), 8).alias("top5"), F.count("*").alias("groups"))


_COVERED = ["repo_url", "lineage_id", "parent_or_source_repo", "paper_title", "paper_authors", "doi", "pubmed_id", "crosswalk_pub_ids", "crosswalk_app_ids", "wayback_first_capture", "commit_zone"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER (trim(coalesce({c}, '')) <> '') AS filled, count(*) FILTER (trim(coalesce({c}, '')) = '') AS missing, round(100.0 * count(*) FILTER (trim(coalesce({c}, '')) <> '') / count(*), 4) AS pct FROM ukb_dmca_repositories" for c in _COVERED))
def variable_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(table(spark, folder, "ukb_dmca_repositories").select(*_COVERED))


_INVENTORY = ("ukb_dmca_repositories", "ukb_dmca_lineages", "stage2_master_projects", "application_level_leakage", "schema19_publications", "schema24_pub_app_links", "curated_application_links", "documents", "events")


@register(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS n FROM {t}" for t in _INVENTORY))
def data_inventory(spark: SparkSession, folder: str) -> DataFrame:
    counts = [table(spark, folder, t).agg(F.lit(t).alias("source"), F.count("*").alias("n")) for t in _INVENTORY]
    return reduce(DataFrame.unionAll, counts)


@register(
    """SELECT n_name, round(avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING'), 6) AS building, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 6) AS machinery, round(avg(c_acctbal) FILTER (c_mktsegment = 'AUTOMOBILE'), 6) AS automobile FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def pivot_means(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = joined.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY", "AUTOMOBILE"]).agg(F.avg("c_acctbal"))
    return wide.select("n_name", *[F.round(c, 6).alias(c.lower()) for c in ("BUILDING", "MACHINERY", "AUTOMOBILE")])


@register(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1)
    SELECT month, 'urgent' AS arm, urgent AS n FROM m UNION ALL SELECT month, 'low', low FROM m"""
)
def stack_long(spark: SparkSession, folder: str) -> DataFrame:
    wide = table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
    return wide.unpivot("month", ["urgent", "low"], "arm", "n")


@register(
    """WITH t AS (SELECT o_orderpriority = '1-URGENT' AS treated, o_orderdate >= TIMESTAMP '1998-01-01' AS post, o_totalprice AS y FROM orders), c AS (SELECT avg(y) FILTER (treated AND post) AS t1, avg(y) FILTER (treated AND NOT post) AS t0, avg(y) FILTER (NOT treated AND post) AS c1, avg(y) FILTER (NOT treated AND NOT post) AS c0 FROM t)
    SELECT round(t1, 6) AS treated_post, round(t0, 6) AS treated_pre, round(c1, 6) AS control_post, round(c0, 6) AS control_pre, round((t1 - t0) - (c1 - c0), 6) AS did FROM c"""
)
def did_of_means(spark: SparkSession, folder: str) -> DataFrame:
    treated, post = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    mean = lambda rule: F.avg(F.when(rule, F.col("o_totalprice")))
    c = table(spark, folder, "orders").agg(mean(treated & post).alias("t1"), mean(treated & ~post).alias("t0"), mean(~treated & post).alias("c1"), mean(~treated & ~post).alias("c0"))
    return c.select(F.round("t1", 6).alias("treated_post"), F.round("t0", 6).alias("treated_pre"), F.round("c1", 6).alias("control_post"), F.round("c0", 6).alias("control_pre"), F.round((F.col("t1") - F.col("t0")) - (F.col("c1") - F.col("c0")), 6).alias("did"))


@register(
    """SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y, count(*) AS n, round(sum(l_quantity), 4) AS sum_y, sum((l_discount > 0)::INT)::BIGINT AS any_y FROM lineitem GROUP BY 1, 2, 3"""
)
def grouped_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_y"), F.sum((F.col("l_discount") > 0).cast("int")).alias("any_y"))


@register("SELECT institution, n FROM (SELECT trim(institution) AS institution, count(*) AS n FROM stage2_master_projects WHERE trim(institution) <> '' GROUP BY 1) ORDER BY n DESC, institution LIMIT 25")
def top_institutions(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "stage2_master_projects").select(F.trim("institution").alias("institution")).filter("institution <> ''").groupBy("institution").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "institution").limit(25)


@register(
    """WITH f AS (SELECT o_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1), c AS (SELECT date_trunc('quarter', d)::DATE AS quarter, c_acctbal < 0 AS hit FROM f JOIN customer ON c_custkey = o_custkey),
    s AS (SELECT unnest(generate_series(least(DATE '1992-01-01', (SELECT min(date_trunc('quarter', o_orderdate))::DATE FROM orders)), greatest(DATE '1998-10-01', (SELECT max(date_trunc('quarter', o_orderdate))::DATE FROM orders)), INTERVAL 3 MONTH))::DATE AS quarter)
    SELECT s.quarter, count(hit) AS n, coalesce(sum(hit::INT), 0)::BIGINT AS events, round(sum(hit::INT) / nullif(count(hit), 0), 6) AS rate FROM s LEFT JOIN c USING (quarter) GROUP BY s.quarter"""
)
def cohort_rates(spark: SparkSession, folder: str) -> DataFrame:
    from strandwork.operators.calendar import spine
    from strandwork.plans.calendar import _span

    first = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d"))
    hits = first.join(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_custkey").groupBy(F.trunc("d", "QUARTER").alias("quarter")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("events"))
    zero = F.lit(0)
    return spine(spark, *_span(spark, folder, "quarter", "1992-01-01", "1998-10-01"), "3 months", "quarter").join(hits, "quarter", "left").select("quarter", F.coalesce("n", zero).alias("n"), F.coalesce("events", zero).alias("events"), F.round(F.try_divide("events", "n"), 6).alias("rate"))


# ---- ordered series ----

_MONTHLY = "m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1)"


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"))


@register(f"WITH {_MONTHLY} SELECT month, row_number() OVER (ORDER BY month) AS time, n, sum(n) OVER (ORDER BY month)::BIGINT AS running FROM m")
def running_total(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.orderBy("month")  # one row per month
    return _monthly(spark, folder).select("month", F.row_number().over(w).cast("bigint").alias("time"), "n", F.sum("n").over(w).alias("running"))


@register(
    f"""WITH {_MONTHLY}, g AS (SELECT month, n - avg(n) OVER () AS gap FROM m), c AS (SELECT month, sum(gap) OVER (ORDER BY month) AS cumulative FROM g)
    SELECT month, round(cumulative, 4) AS cumulative, round(min(cumulative) OVER (ORDER BY month), 4) AS lowest FROM c"""
)
def cumulative_gap(spark: SparkSession, folder: str) -> DataFrame:
    w, every = Window.orderBy("month"), Window.partitionBy()
    c = _monthly(spark, folder).withColumn("gap", F.col("n") - F.avg("n").over(every)).withColumn("c", F.sum("gap").over(w))
    return c.select("month", F.round("c", 4).alias("cumulative"), F.round(F.min("c").over(w), 4).alias("lowest"))


@register(f"WITH {_MONTHLY} SELECT month, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS ma3 FROM m")
def moving_average3(spark: SparkSession, folder: str) -> DataFrame:
    return _monthly(spark, folder).select("month", F.round(F.avg("n").over(Window.orderBy("month").rowsBetween(-2, 0)), 6).alias("ma3"))


@register(
    """WITH a AS (SELECT p_size AS age, count(*) AS risk, count(*) FILTER (p_retailprice > 1400) AS events FROM part GROUP BY 1)
    SELECT age, round(sum(events) OVER (ORDER BY age ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / sum(risk) OVER (ORDER BY age ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 8) AS rate FROM a"""
)
def centered_rates(spark: SparkSession, folder: str) -> DataFrame:
    by_age = table(spark, folder, "part").groupBy(F.col("p_size").alias("age")).agg(F.count("*").alias("risk"), F.count_if(F.col("p_retailprice") > 1400).alias("events"))
    w = Window.orderBy("age").rowsBetween(-2, 2)
    return by_age.select("age", F.round(F.sum("events").over(w) / F.sum("risk").over(w), 8).alias("rate"))


@register(
    f"""WITH {_MONTHLY}, r AS (SELECT month, sum(n) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS total, row_number() OVER (ORDER BY month) AS i FROM m)
    SELECT a.month, a.total, round((SELECT avg((b.total <= a.total)::INT) FROM r b WHERE b.i >= 3), 6) AS percentile FROM r a WHERE a.i >= 3"""
)
def rolling3_percentile(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.orderBy("month")
    r = _monthly(spark, folder).select("month", F.sum("n").over(w.rowsBetween(-2, 0)).alias("total"), F.row_number().over(w).alias("i")).filter("i >= 3")
    return r.select("month", "total", F.round(F.cume_dist().over(Window.orderBy("total")), 6).alias("percentile"))


@register(
    """WITH t AS (SELECT n_regionkey AS family, n_nationkey AS test, (n_nationkey * 7 % 13 + 1) / 100.0 AS p FROM nation), r AS (SELECT *, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) AS s FROM t)
    SELECT family, test, p, round(least(1, max(s) OVER (PARTITION BY family ORDER BY p, test)), 8) AS holm_p FROM r"""
)
def holm_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    tests = table(spark, folder, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), ((F.col("n_nationkey") * 7 % 13 + 1) / 100.0).alias("p"))
    return holm(tests, ["family"], "p", "test").select("family", "test", "p", F.round("holm_p", 8).alias("holm_p"))


@register(
    """WITH s AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
    SELECT a.s_nationkey, a.s_suppkey AS best, b.s_suppkey AS second, round(a.s_acctbal - coalesce(b.s_acctbal, 0), 4) AS gap FROM s a LEFT JOIN s b ON b.s_nationkey = a.s_nationkey AND b.r = 2 WHERE a.r = 1"""
)
def second_best_gap(spark: SparkSession, folder: str) -> DataFrame:
    from strandwork.operators.ordered import top_k

    two = top_k(table(spark, folder, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 2)
    pick = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return two.groupBy("s_nationkey").agg(pick(1, "s_suppkey").alias("best"), pick(2, "s_suppkey").alias("second"), F.round(pick(1, "s_acctbal") - F.coalesce(pick(2, "s_acctbal"), F.lit(0)), 4).alias("gap"))


@register(
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS example FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) SELECT p_brand, p_type, example FROM r WHERE r <= 3"""
)
def diverse_examples(spark: SparkSession, folder: str) -> DataFrame:
    """For each class up to three examples, each of another kind, the most frequent kinds first."""
    from strandwork.operators.ordered import top_k

    kinds = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("example"))
    return top_k(kinds, ["p_brand"], [F.col("n").desc(), F.col("p_type")], 3).select("p_brand", "p_type", "example")


@register(
    """WITH k AS (SELECT user_id, event_type, min(event_id) AS k FROM events GROUP BY 1, 2), l AS (SELECT user_id, list(event_type ORDER BY k) AS v FROM k GROUP BY 1)
    SELECT user_id, array_to_string(v[1:2], '; ') || CASE WHEN len(v) > 2 THEN '... +' || (len(v) - 2) || ' more' ELSE '' END AS evidence FROM l"""
)
def truncated_list(spark: SparkSession, folder: str) -> DataFrame:
    firsts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("k"))
    lists = firsts.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type"))), lambda x: x["event_type"]).alias("v"))
    more = F.when(F.size("v") > 2, F.concat(F.lit("... +"), (F.size("v") - 2).cast("string"), F.lit(" more"))).otherwise("")
    return lists.select("user_id", F.concat(F.array_join(F.slice("v", 1, 2), "; "), more).alias("evidence"))
