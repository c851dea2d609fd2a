"""Queries of scored candidates, notices, flags and fixed cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.functions.structured import find_keys, merge_maps
from strandwork.operators import calendar as C
from strandwork.operators import linkage as K
from strandwork.operators.references import whole_number
from strandwork.plans.registry import Register
from strandwork.plans.texts import _PLAIN
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_P = lambda c: _PLAIN.format(c)
_SCORED = f"""WITH l AS (SELECT row_id, {_P("application_title")} AS title, {_P("application_institution")} AS inst, {_P("application_pi")} AS pi FROM application_level_leakage WHERE application_title IS NOT NULL),
r AS (SELECT row_id AS reg_id, {_P("title")} AS title, {_P("institution")} AS inst, {_P("pi")} AS pi FROM stage2_master_projects WHERE title IS NOT NULL),
p AS (SELECT l.row_id, r.reg_id, CASE WHEN l.title = r.title THEN 35.0 ELSE 0 END AS t, CASE WHEN l.inst = r.inst AND l.inst <> '' THEN 15.0 ELSE 0 END AS i, CASE WHEN l.pi = r.pi AND l.pi <> '' THEN 20.0 ELSE 0 END AS n FROM l JOIN r ON (l.title = r.title AND l.title <> '') OR (l.pi = r.pi AND l.pi <> '')),
s AS (SELECT row_id, reg_id, coalesce(t, 0) + coalesce(i, 0) + coalesce(n, 0) AS score, (coalesce(t, 0) > 0)::INT + (coalesce(n, 0) > 0)::INT AS strong FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, reg_id::VARCHAR) AS rank FROM s WHERE score > 0), g AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY row_id ORDER BY rank), 0) AS second FROM k WHERE rank <= 5)"""


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, list[K.Component]]:
    fields = lambda df, i, t, n, p: df.filter(F.col(t).isNotNull()).select(i, T.plain(F.col(t)).alias("title"), T.plain(F.col(n)).alias("inst"), T.plain(F.col(p)).alias("pi"))
    left = fields(table(spark, folder, "application_level_leakage"), "row_id", "application_title", "application_institution", "application_pi")
    right = fields(table(spark, folder, "stage2_master_projects").withColumnRenamed("row_id", "reg_id"), "reg_id", "title", "institution", "pi")
    pairs = K.best_pairs(left, right, "row_id", "reg_id", ["title", "inst", "pi"], ["title", "pi"], 5)
    both = pairs.join(left, "row_id").join(right.select("reg_id", F.col("title").alias("title2"), F.col("inst").alias("inst2"), F.col("pi").alias("pi2")), "reg_id")
    same = lambda c, points: F.when((F.col(c) == F.col(f"{c}2")) & (F.col(c) != ""), points)
    components = [K.Component("title", same("title", 35.0)), K.Component("institution", same("inst", 15.0), False), K.Component("pi", same("pi", 20.0))]
    return K.score_pairs(both, components), components


@register(f"{_SCORED} SELECT row_id, reg_id, rank::INT AS rank, round(score, 2)::DOUBLE AS score, round(score - second, 2)::DOUBLE AS gap, CASE WHEN rank > 1 THEN 'candidate' WHEN score >= 70 AND strong >= 2 AND score - second >= 12 THEN 'probable' WHEN score >= 45 AND second >= score - 10 THEN 'ambiguous' WHEN score >= 50 AND strong >= 2 THEN 'ambiguous' ELSE 'unresolved' END AS grade FROM g")
def graded_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that share a title or a lead, the best five of each with the gap to the second and a grade."""
    scored, _ = _scored(spark, folder)
    return K.rank_and_grade(scored, "row_id", "reg_id", 5, (70, 2, 12)).select("row_id", "reg_id", "rank", "score", "gap", "grade")


@register(f"{_SCORED} SELECT component, strength, count(*) AS n, round(sum(points), 2)::DOUBLE AS points FROM (SELECT 'title' AS component, 'strong' AS strength, t AS points FROM p SEMI JOIN g USING (row_id, reg_id) UNION ALL SELECT 'institution', 'weak', i FROM p SEMI JOIN g USING (row_id, reg_id) UNION ALL SELECT 'pi', 'strong', n FROM p SEMI JOIN g USING (row_id, reg_id)) WHERE points > 0 GROUP BY ALL")
def evidence_long(spark: SparkSession, folder: str) -> DataFrame:
    """The components behind the best five candidates."""
    scored, components = _scored(spark, folder)
    best = K.rank_and_grade(scored, "row_id", "reg_id", 5)
    return K.evidence_rows(best, ["row_id", "reg_id"], components).groupBy("component", "strength").agg(F.count("*").alias("n"), F.round(F.sum("points"), 2).alias("points"))


@register(
    r"""WITH n AS (SELECT doc_id, regexp_extract(text, 'Notice of ([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})', 1) AS said, regexp_extract(text, 'codehost\.example/([^/\s]+/[^/\s]+)', 1) AS target, regexp_extract(text, 'contains ([a-z ]+) from the cohort', 1) AS kind, regexp_matches(lower(text), 'retract') AS retracted FROM documents WHERE source = 'notice_letter' AND text IS NOT NULL),
    d AS (SELECT *, try_strptime(said, '%d %B %Y')::DATE AS noticed FROM n) SELECT doc_id, noticed, target, kind, retracted, count(*) OVER (PARTITION BY noticed) AS same_day FROM d WHERE noticed IS NOT NULL"""
)
def parsed_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Date, target and kind of data of notices, and how many share their day (counted and joined back, so that a hot day isn't one task)."""
    part = lambda p: F.regexp_extract("text", p, 1)
    notices = table(spark, folder, "documents").filter("source = 'notice_letter' and text is not null").select(
        "doc_id", F.try_to_timestamp(part("Notice of ([0-9]{1,2} [A-Z][a-z]+ [0-9]{4})"), F.lit("d MMMM yyyy")).cast("date").alias("noticed"), part(r"codehost\.example/([^/\s]+/[^/\s]+)").alias("target"),
        part("contains ([a-z ]+) from the cohort").alias("kind"), F.lower("text").rlike("retract").alias("retracted"),
    ).filter("noticed is not null")
    return notices.join(notices.groupBy("noticed").agg(F.count("*").alias("same_day")), "noticed").select("doc_id", "noticed", "target", "kind", "retracted", "same_day")


_FLAGS = {"imaging": ("imaging", "retinal"), "genomics": ("genotype", "genetic", "polygenic", "exome"), "activity": ("acceler", "physical activity"), "records": ("hospital", "death registr", "prescription")}


@register(
    "WITH f AS (SELECT doc_id, " + ", ".join("(" + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f")::INT AS {n}" for n, ws in _FLAGS.items()) + " FROM documents WHERE text IS NOT NULL) SELECT *, CASE "
    + " ".join(f"WHEN {n} = 1 THEN '{n}'" for n in _FLAGS) + " END AS first_flag FROM f"
)
def keyword_flags(spark: SparkSession, folder: str) -> DataFrame:
    """0/1 per group of words, and the first group that holds."""
    hit = {n: F.lit(False) for n in _FLAGS}
    for n, ws in _FLAGS.items():
        for w in ws:
            hit[n] = hit[n] | F.contains(F.lower("text"), F.lit(w))
    flags = table(spark, folder, "documents").filter("text is not null").select("doc_id", *[x.cast("int").alias(n) for n, x in hit.items()])
    return flags.withColumn("first_flag", F.coalesce(*[F.when(F.col(n) == 1, n) for n in _FLAGS]))


@register("SELECT event_id, array_to_string([json_extract_string(props, '$.k')], ',') AS found FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_key_search(spark: SparkSession, folder: str) -> DataFrame:
    return find_keys(table(spark, folder, "events").select("event_id", "props"), "props", ("K",)).filter(F.size("found") > 0).select("event_id", F.array_join("found", ",").alias("found"))


@register("SELECT n_nationkey, 'new' AS kept, n_name AS name, 'r' || n_regionkey AS extra FROM nation")
def merged_maps(spark: SparkSession, folder: str) -> DataFrame:
    a = F.create_map(F.lit("kept"), F.lit("old"), F.lit("name"), F.col("n_name"))
    b = F.create_map(F.lit("kept"), F.lit("new"), F.lit("extra"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    m = merge_maps(a, b)
    return table(spark, folder, "nation").select("n_nationkey", *[m[k].alias(k) for k in ("kept", "name", "extra")])


_LAG = "min(c.first_dmca_notice_date)"


@register(
    f"""WITH a AS (SELECT TRY_CAST(regexp_extract(app_id, '^\\s*([0-9]+)', 1) AS BIGINT) AS app, min(first_dmca_notice_date) AS first_notice FROM curated_application_links GROUP BY 1),
    p AS (SELECT TRY_CAST(regexp_extract(app_id, '^\\s*([0-9]+)', 1) AS BIGINT) AS app, min(first_publication_date) AS first_pub FROM stage2_master_projects GROUP BY 1)
    SELECT app, first_notice, first_pub, date_diff('day', first_pub, first_notice) AS lag_days, (first_notice <= first_pub + INTERVAL 12 MONTH)::INT AS within_year, (first_notice <= first_pub + INTERVAL 24 MONTH)::INT AS within_two_years,
    CASE WHEN first_pub IS NULL THEN 'undated' WHEN first_notice < first_pub THEN 'before' ELSE 'after' END AS status FROM a JOIN p USING (app)"""
)
def notice_timing(spark: SparkSession, folder: str) -> DataFrame:
    """Days from an application's first publication to its first notice, with flags of inclusive windows."""
    key = whole_number(F.col("app_id")).alias("app")
    a = table(spark, folder, "curated_application_links").select(key, "first_dmca_notice_date").groupBy("app").agg(F.min("first_dmca_notice_date").alias("first_notice"))
    p = table(spark, folder, "stage2_master_projects").select(key, "first_publication_date").groupBy("app").agg(F.min("first_publication_date").alias("first_pub"))
    within = lambda k: (F.col("first_notice") <= F.add_months("first_pub", k)).cast("int")
    status = F.when(F.col("first_pub").isNull(), "undated").when(F.col("first_notice") < F.col("first_pub"), "before").otherwise("after")
    return a.join(p, "app").select("app", "first_notice", "first_pub", F.datediff("first_notice", "first_pub").cast("bigint").alias("lag_days"), within(12).alias("within_year"), within(24).alias("within_two_years"), status.alias("status"))


@register(
    """WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1), c AS (SELECT o_custkey FROM s WHERE d < DATE '1996-01-01'), m AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 1 MONTH))::DATE AS month),
    n AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders JOIN c USING (o_custkey) GROUP BY 1) SELECT m.month, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM c), 6) AS per_100 FROM m LEFT JOIN n USING (month)"""
)
def fixed_cohort_intensity(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"))
    members = orders.groupBy("o_custkey").agg(F.min("d").alias("first")).filter("first < '1996-01-01'").select("o_custkey")
    counts = orders.join(members, "o_custkey", "left_semi").groupBy(F.trunc("d", "MM").alias("month")).agg(F.count("*").alias("n"))
    size = members.agg(F.count("*").alias("size"))  # one row
    filled = C.gap_filled(C.spine(spark, "1996-01-01", "2001-07-01", "1 month", "month"), counts, "month", ["n"])
    return filled.join(F.broadcast(size)).select("month", "n", F.round(100.0 * F.col("n") / F.col("size"), 6).alias("per_100"))


@register(
    """WITH s AS (SELECT o_custkey, date_trunc('month', min(o_orderdate))::DATE AS start FROM orders GROUP BY 1), e AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY 1, 2),
    m AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-07-01', INTERVAL 1 MONTH))::DATE AS month), r AS (SELECT m.month, date_diff('month', s.start, m.month) AS age, count(*) AS active, coalesce(sum(e.n), 0) AS n FROM m JOIN s ON s.start <= m.month LEFT JOIN e ON e.o_custkey = s.o_custkey AND e.month = m.month GROUP BY 1, 2),
    a AS (SELECT age, sum(n) / sum(active) AS rate FROM r WHERE month < DATE '1998-07-01' GROUP BY age), t AS (SELECT max(age) AS top, arg_max(rate, age) AS last_rate FROM a)
    SELECT month, sum(n)::BIGINT AS observed, round(sum(active * coalesce(a.rate, t.last_rate)), 6) AS expected FROM r LEFT JOIN a USING (age), t GROUP BY month"""
)
def pipeline_expected(spark: SparkSession, folder: str) -> DataFrame:
    """Counts expected from the ages of the active entities at the rates seen before the break; ages not seen by then take the last rate.

    Active entities per month and age follow from the number of starts per month: no panel of entities is made.
    """
    orders = table(spark, folder, "orders").select("o_custkey", F.trunc("o_orderdate", "MM").alias("month"))
    starts = orders.groupBy("o_custkey").agg(F.min("month").alias("start"))
    cohorts = starts.groupBy("start").agg(F.count("*").alias("active"))
    events = orders.join(starts, "o_custkey").groupBy("start", "month").agg(F.count("*").alias("n"))
    grid = cohorts.select("start", "active", F.explode(F.sequence("start", F.lit("2001-07-01").cast("date"), F.expr("interval 1 month"))).alias("month")).filter("month >= '1995-01-01'")
    r = grid.join(events, ["start", "month"], "left").groupBy("month", C.calendar_months(F.col("start"), F.col("month")).alias("age")).agg(F.sum("active").alias("active"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    a = r.filter("month < '1998-07-01'").groupBy("age").agg((F.sum("n") / F.sum("active")).alias("rate"))
    last = a.agg(F.max_by("rate", "age").alias("last_rate"))  # one row
    return r.join(a, "age", "left").join(F.broadcast(last)).groupBy("month").agg(F.sum("n").alias("observed"), F.round(F.sum(F.col("active") * F.coalesce("rate", "last_rate")), 6).alias("expected"))


@register(
    """WITH c AS (SELECT month(o_orderdate) AS m, count(*) FILTER (o_totalprice > 495000) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT m, y, n, y > 0 AND y < n AS usable FROM c"""
)
def separation_check(spark: SparkSession, folder: str) -> DataFrame:
    """Groups in which the outcome varies; the others would send a coefficient to infinity and are left out of a design."""
    c = table(spark, folder, "orders").groupBy(F.month("o_orderdate").cast("bigint").alias("m")).agg(F.count_if(F.col("o_totalprice") > 495000).alias("y"), F.count("*").alias("n"))
    return c.withColumn("usable", (F.col("y") > 0) & (F.col("y") < F.col("n")))


@register(
    """SELECT row_id, CASE WHEN regexp_matches(trim(app_id), '^[+-]?[0-9]+$') THEN trim(app_id)::BIGINT ELSE 1000000000000000000 END AS key, row_number() OVER (ORDER BY CASE WHEN regexp_matches(trim(app_id), '^[+-]?[0-9]+$') THEN trim(app_id)::BIGINT ELSE 1000000000000000000 END, app_id, row_id) AS place FROM stage2_master_projects"""
)
def numeric_aware_order(spark: SparkSession, folder: str) -> DataFrame:
    """Places in the order of whole numbers, other texts last.

    Rows are sorted by range over all tasks and numbered within each range, to which the sizes of those before it are added.
    """
    rows = table(spark, folder, "stage2_master_projects").select("row_id", "app_id", F.when(F.trim("app_id").rlike(r"^[+-]?\d+$"), F.trim("app_id").try_cast("bigint")).otherwise(F.lit(10**18)).alias("key"))
    from strandwork.session import cut

    spread = cut(rows.repartitionByRange("key", "app_id", "row_id").withColumn("part", F.spark_partition_id()))
    sizes = spread.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("key", "app_id", "row_id"))
    return spread.join(F.broadcast(before), "part").select("row_id", "key", (within + F.col("before")).alias("place"))
