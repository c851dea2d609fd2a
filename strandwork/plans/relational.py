"""Queries of joins, lookups, overlays and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators import relational as R
from strandwork.operators.references import whole_number
from strandwork.plans.problems import _KEY
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


@register("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    return R.dedupe(table(spark, folder, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@register("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def dedupe_last(spark: SparkSession, folder: str) -> DataFrame:
    return R.dedupe(table(spark, folder, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"], "last")


@register(
    f"""WITH k AS (SELECT {_KEY.format("app_id")} AS app_key, trim(title) AS title, trim(institution) AS institution FROM stage2_master_projects)
    SELECT app_key, count(*) AS copies, count(DISTINCT coalesce(title, '~') || '|' || coalesce(institution, '~')) = 1 AS exact FROM k GROUP BY app_key HAVING count(*) > 1"""
)
def duplicate_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stage2_master_projects").select(whole_number(F.col("app_id")).alias("app_key"), F.trim("title").alias("title"), F.trim("institution").alias("institution"))
    return R.duplicate_audit(rows, ["app_key"], [], ["title", "institution"])


@register(
    f"""WITH p AS (SELECT {_KEY.format("app_id")} AS k, title, row_number() OVER (PARTITION BY {_KEY.format("app_id")} ORDER BY row_id DESC) AS n FROM stage2_master_projects)
    SELECT c.link_id, {_KEY.format("c.app_id")} AS app_key, p.title AS register_title FROM curated_application_links c LEFT JOIN p ON p.k = {_KEY.format("c.app_id")} AND p.n = 1"""
)
def lookup_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "curated_application_links").select("link_id", whole_number(F.col("app_id")).alias("app_key"))
    register_ = table(spark, folder, "stage2_master_projects").select(whole_number(F.col("app_id")).alias("app_key"), F.col("title").alias("register_title"), "row_id")
    return R.lookup(links, register_, "app_key", ["row_id"]).select("link_id", "app_key", "register_title")


_BRIDGE = f"""WITH l AS (SELECT {_KEY.format("app_id")} AS app, {_KEY.format("pub_id")} AS pub, count(*) AS copies FROM schema24_pub_app_links GROUP BY ALL),
a AS (SELECT DISTINCT {_KEY.format("app_id")} AS app FROM stage2_master_projects WHERE deleted_at IS NULL),
p AS (SELECT DISTINCT {_KEY.format("pub_id")} AS pub FROM schema19_publications WHERE deleted_at IS NULL),
b AS (SELECT l.app, l.pub, copies, CASE WHEN l.app IS NULL OR l.pub IS NULL THEN 'bad_key' WHEN a.app IS NULL AND p.pub IS NULL THEN 'neither' WHEN a.app IS NULL THEN 'no_a' WHEN p.pub IS NULL THEN 'no_b' ELSE 'ok' END AS issue
      FROM l LEFT JOIN a ON a.app = l.app LEFT JOIN p ON p.pub = l.pub)"""


def _bridge(spark: SparkSession, folder: str) -> DataFrame:
    held = lambda name, key, out: table(spark, folder, name).filter("deleted_at is null").select(whole_number(F.col(key)).alias(out)).filter(F.col(out).isNotNull()).distinct()
    links = table(spark, folder, "schema24_pub_app_links").select(whole_number(F.col("app_id")).alias("app"), whole_number(F.col("pub_id")).alias("pub"))
    return R.bridge(links, held("stage2_master_projects", "app_id", "app"), held("schema19_publications", "pub_id", "pub"), "app", "pub")


@register(f"{_BRIDGE} SELECT app, pub, copies FROM b WHERE issue = 'ok'")
def bridge_events(spark: SparkSession, folder: str) -> DataFrame:
    return _bridge(spark, folder).filter("issue = 'ok'").select("app", "pub", "copies")


@register(f"{_BRIDGE} SELECT issue, count(*) AS pairs, sum(copies)::BIGINT AS links FROM b GROUP BY issue")
def bridge_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _bridge(spark, folder).groupBy("issue").agg(F.count("*").alias("pairs"), F.sum("copies").alias("links"))


@register(
    f"""WITH ids AS (SELECT DISTINCT repo_row_id, {_KEY.format("x")} AS pub FROM (SELECT repo_row_id, unnest(regexp_extract_all(crosswalk_pub_ids, '[0-9]+(\\.[0-9]+)?')) AS x FROM ukb_dmca_repositories)),
    links AS (SELECT DISTINCT {_KEY.format("app_id")} AS app, {_KEY.format("pub_id")} AS pub FROM schema24_pub_app_links)
    SELECT repo_row_id, count(DISTINCT pub) AS pubs, count(DISTINCT app) AS apps, min(app) AS first_app FROM ids JOIN links USING (pub) GROUP BY repo_row_id"""
)
def crosswalk_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Repository rows to publications to applications through the exploded identifiers of the crosswalk."""
    ids = table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("crosswalk_pub_ids", F.lit(r"[0-9]+(\.[0-9]+)?"), F.lit(0)), whole_number))).alias("pub"))
    links = table(spark, folder, "schema24_pub_app_links").select(whole_number(F.col("app_id")).alias("app"), whole_number(F.col("pub_id")).alias("pub")).dropna().distinct()
    return ids.join(links, "pub").groupBy("repo_row_id").agg(F.count_distinct("pub").alias("pubs"), F.count_distinct("app").alias("apps"), F.min("app").alias("first_app"))


_PHRASES = ["sleep duration", "blood pressure", "vitamin d", "heart failure", "type 2 diabetes", "hip fracture", "secure platform", "open questions"]


@register(
    "SELECT doc_id, phrase FROM documents, (SELECT unnest([" + ", ".join(f"'{p}'" for p in _PHRASES) + "]) AS phrase) "
    "WHERE contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || phrase || ' ')"
)
def theta_contains(spark: SparkSession, folder: str) -> DataFrame:
    return R.phrases_in(table(spark, folder, "documents").select("doc_id", "text"), "text", _PHRASES).select("doc_id", "phrase")


_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@register(
    f"""WITH r AS (SELECT {_NORM.format("title")} AS t, {_KEY.format("app_id")} AS k, lower(trim(institution)) AS i FROM stage2_master_projects WHERE deleted_at IS NULL AND title IS NOT NULL),
    u AS (SELECT t, count(DISTINCT k) AS n, min(k) AS k FROM r WHERE t <> '' GROUP BY t), s AS (SELECT t, i, count(DISTINCT k) AS n, min(k) AS k FROM r GROUP BY t, i),
    a AS (SELECT row_id, {_NORM.format("application_title")} AS t, lower(trim(application_institution)) AS i FROM application_level_leakage)
    SELECT a.row_id, CASE WHEN u.n IS NULL THEN 'none' WHEN u.n = 1 THEN 'title' WHEN s.n = 1 THEN 'title and institution' ELSE 'ambiguous' END AS status, CASE WHEN u.n = 1 THEN u.k WHEN s.n = 1 THEN s.k END AS app_key
    FROM a LEFT JOIN u ON u.t = a.t LEFT JOIN s ON s.t = a.t AND s.i = a.i"""
)
def title_equi_match(spark: SparkSession, folder: str) -> DataFrame:
    norm = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    r = table(spark, folder, "stage2_master_projects").filter("deleted_at is null and title is not null").select(norm(F.col("title")).alias("t"), whole_number(F.col("app_id")).alias("k"), F.lower(F.trim("institution")).alias("i"))
    u = r.filter("t <> ''").groupBy("t").agg(F.count_distinct("k").alias("n"), F.min("k").alias("k"))
    s = r.groupBy("t", "i").agg(F.count_distinct("k").alias("sn"), F.min("k").alias("sk"))
    a = table(spark, folder, "application_level_leakage").select("row_id", norm(F.col("application_title")).alias("t"), F.lower(F.trim("application_institution")).alias("i"))
    status = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "title").when(F.col("sn") == 1, "title and institution").otherwise("ambiguous")
    return a.join(u, "t", "left").join(s, ["t", "i"], "left").select("row_id", status.alias("status"), F.when(F.col("n") == 1, F.col("k")).when(F.col("sn") == 1, F.col("sk")).alias("app_key"))


@register(
    f"""SELECT a.row_id, max(CASE WHEN lower(trim(a.application_institution)) = lower(trim(p.institution)) OR starts_with(lower(trim(a.application_institution)), lower(trim(p.institution))) OR starts_with(lower(trim(p.institution)), lower(trim(a.application_institution)))
    OR lower(trim(split_part(a.application_institution, ',', 1))) = lower(trim(split_part(p.institution, ',', 1))) THEN 1 ELSE 0 END)::INT AS institution_agrees
    FROM application_level_leakage a JOIN stage2_master_projects p ON {_KEY.format("p.app_id")} = a.application_id WHERE a.application_institution IS NOT NULL AND p.institution IS NOT NULL GROUP BY a.row_id"""
)
def institution_prefix_match(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "application_level_leakage").filter("application_institution is not null").select("row_id", F.col("application_id").alias("k"), F.lower(F.trim("application_institution")).alias("x"))
    p = table(spark, folder, "stage2_master_projects").filter("institution is not null").select(whole_number(F.col("app_id")).alias("k"), F.lower(F.trim("institution")).alias("y"))
    head = lambda c: F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    agrees = (F.col("x") == F.col("y")) | F.col("x").startswith(F.col("y")) | F.col("y").startswith(F.col("x")) | (head(F.col("x")) == head(F.col("y")))
    return a.join(p, "k").groupBy("row_id").agg(F.max(agrees.cast("int")).alias("institution_agrees"))


@register("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_members(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@register("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_members(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register(
    """SELECT s_nationkey, s_suppkey, s_acctbal, rank::INT AS rank FROM (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) WHERE rank <= 3"""
)
def topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    from strandwork.operators.ordered import top_k

    return top_k(table(spark, folder, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 3)


@register(
    """WITH a AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT month, round(a - r, 4) AS difference FROM a WHERE a IS NOT NULL AND r IS NOT NULL"""
)
def paired_difference(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).alias("a"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("r"))
    return s.filter("a is not null and r is not null").select("month", F.round(F.col("a") - F.col("r"), 4).alias("difference"))


@register(
    f"""WITH l AS (SELECT {_KEY.format("app_id")} AS id, 0 AS layer FROM stage2_master_projects UNION SELECT application_id, 1 FROM application_level_leakage UNION SELECT {_KEY.format("app_id")}, 2 FROM curated_application_links UNION SELECT {_KEY.format("app_id")}, 3 FROM schema24_pub_app_links),
    f AS (SELECT id, min(layer) AS layer FROM l GROUP BY id), m AS (SELECT layer, count(*) AS members FROM l GROUP BY layer), n AS (SELECT layer, count(*) AS "new" FROM f GROUP BY layer)
    SELECT m.layer, members, coalesce("new", 0) AS "new", sum(coalesce("new", 0)) OVER (ORDER BY m.layer)::BIGINT AS cumulative FROM m LEFT JOIN n USING (layer)"""
)
def channel_net_additions(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda name, c: table(spark, folder, name).select(whole_number(F.col(c)).alias("id"))
    channels = [key("stage2_master_projects", "app_id"), table(spark, folder, "application_level_leakage").select(F.col("application_id").alias("id")), key("curated_application_links", "app_id"), key("schema24_pub_app_links", "app_id")]
    return R.net_additions(R.union_rows(*[c.withColumn("layer", F.lit(i)) for i, c in enumerate(channels)]))


@register(
    f"""WITH e AS (SELECT DISTINCT {_KEY.format("app_id")} AS id FROM stage2_master_projects WHERE deleted_at IS NULL), o AS (SELECT DISTINCT application_id AS id FROM application_level_leakage)
    SELECT count(*) FILTER (e.id IS NOT NULL AND o.id IS NOT NULL) AS matched, count(*) FILTER (o.id IS NULL) AS missing, count(*) FILTER (e.id IS NULL) AS extra,
    CASE WHEN count(*) FILTER (o.id IS NULL) = 0 AND count(*) FILTER (e.id IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM e FULL OUTER JOIN o ON e.id = o.id"""
)
def reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    expected = table(spark, folder, "stage2_master_projects").filter("deleted_at is null").select(whole_number(F.col("app_id")).alias("id"))
    return R.reconcile(expected, table(spark, folder, "application_level_leakage").select(F.col("application_id").alias("id")), ["id"])


@register(
    """SELECT coalesce(c.c_custkey, o.k) AS c_custkey, coalesce(o.s, c.c_mktsegment) AS segment, o.k IS NOT NULL AS changed FROM customer c FULL OUTER JOIN
    (SELECT o_custkey AS k, min(o_orderpriority) AS s FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey) o ON o.k = c.c_custkey"""
)
def overlay_merge(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = table(spark, folder, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("segment"))
    return R.overlay(base, changes, ["c_custkey"])


@register(
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'only A', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'only R', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')"""
)
def set_differences(spark: SparkSession, folder: str) -> DataFrame:
    # one pass and one aggregation by key give all three parts
    part = table(spark, folder, "lineitem").filter("l_returnflag in ('A', 'R')").groupBy("l_partkey").agg(F.max((F.col("l_returnflag") == "A").cast("int")).alias("a"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    counts = part.agg(F.sum(F.col("a") * F.col("r")).alias("both"), F.sum(F.col("a") * (1 - F.col("r"))).alias("a"), F.sum(F.col("r") * (1 - F.col("a"))).alias("r"))
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for n, c in (("both", "both"), ("only A", "a"), ("only R", "r"))])))


@register(
    """SELECT doc_id, min(layer) AS layer, ['script notice', 'notice letter', 'readme', 'other review'][min(layer) + 1] AS name FROM (
    SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'javascript') THEN 0 WHEN regexp_matches(text, '^Notice of') THEN 1 WHEN regexp_matches(text, '^# ') THEN 2 WHEN source = 'review_note' THEN 3 END AS layer FROM documents) WHERE layer IS NOT NULL GROUP BY doc_id"""
)
def rule_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    rules = [("script notice", F.lower("text").rlike("javascript")), ("notice letter", F.col("text").rlike("^Notice of")), ("readme", F.col("text").rlike("^# ")), ("other review", F.col("source") == "review_note")]
    return R.first_rule(table(spark, folder, "documents").select("doc_id", "text", "source"), "doc_id", rules)


@register(
    f"""WITH a AS (SELECT DISTINCT lower(repo_name) AS family, {_KEY.format("c.app_id")} AS app FROM (SELECT app_id, unnest(regexp_extract_all(linked_repo_urls, 'codehost.example/([^/;,| \n]+/[^/;,| \n]+)', 1)) AS r FROM curated_application_links) c JOIN ukb_dmca_repositories ON lower(repo_owner || '/' || repo_name) = lower(c.r)),
    f AS (SELECT family, count(DISTINCT app) AS apps, min(app) AS app FROM a GROUP BY family)
    SELECT r.repo_row_id, CASE WHEN f.apps = 1 THEN 'single' ELSE 'ambiguous' END AS status, CASE WHEN f.apps = 1 THEN f.app END AS app FROM ukb_dmca_repositories r JOIN f ON f.family = lower(r.repo_name)"""
)
def anchor_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Applications of repositories that curated links name, carried over to all repositories of the same name; more than one is ambiguous."""
    links = table(spark, folder, "curated_application_links").select(whole_number(F.col("app_id")).alias("app"), F.explode(F.regexp_extract_all("linked_repo_urls", F.lit(r"codehost.example/([^/;,| \n]+/[^/;,| \n]+)"), F.lit(1))).alias("r"))
    repos = table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", F.lower("repo_name").alias("family"), F.lower(F.concat("repo_owner", F.lit("/"), "repo_name")).alias("full"))
    anchors = links.select(F.lower("r").alias("full"), "app").distinct().join(repos.select("full", "family").distinct(), "full").groupBy("family").agg(F.count_distinct("app").alias("apps"), F.min("app").alias("app"))
    return repos.join(anchors, "family").select("repo_row_id", F.when(F.col("apps") == 1, "single").otherwise("ambiguous").alias("status"), F.when(F.col("apps") == 1, F.col("app")).alias("app"))
