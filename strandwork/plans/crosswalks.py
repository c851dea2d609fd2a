"""Queries that bring tables together by identifiers, titles and phrases, and that check what a split must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.operators import relational as R
from strandwork.operators.references import whole_number
from strandwork.plans.problems import _KEY
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_DOI, _PMID, _LEAST = r"10\.[0-9]{4,9}/[a-z0-9.()-]+", "[0-9]{6,9}", 20
_NORM = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_LEGS = f"""WITH p AS (SELECT DISTINCT {_KEY.format("pub_id")} AS pub, lower(doi) AS doi, pubmed_id, {_NORM.format("title")} AS title FROM schema19_publications),
pd AS (SELECT DISTINCT pub, unnest(regexp_extract_all(doi, '{_DOI}')) AS k FROM p), pm AS (SELECT DISTINCT pub, unnest(regexp_extract_all(pubmed_id, '{_PMID}')) AS k FROM p), pt AS (SELECT DISTINCT pub, title AS k FROM p WHERE length(title) >= {_LEAST}),
r AS (SELECT repo_row_id, lower(doi) AS doi, pubmed_id, {_NORM.format("paper_title")} AS title FROM ukb_dmca_repositories),
legs AS (SELECT repo_row_id, 'doi' AS leg, pub FROM (SELECT DISTINCT repo_row_id, unnest(regexp_extract_all(doi, '{_DOI}')) AS k FROM r) JOIN pd USING (k) WHERE pub IS NOT NULL
 UNION SELECT repo_row_id, 'pmid', pub FROM (SELECT DISTINCT repo_row_id, unnest(regexp_extract_all(pubmed_id, '{_PMID}')) AS k FROM r) JOIN pm USING (k) WHERE pub IS NOT NULL
 UNION SELECT repo_row_id, 'title', pub FROM (SELECT repo_row_id, title AS k FROM r) JOIN pt USING (k) WHERE pub IS NOT NULL)"""


def publication_legs(repos: DataFrame, pubs: DataFrame, least: int = _LEAST) -> DataFrame:
    """(repo_row_id, leg, pub): publications that a row names by DOI, by PubMed id or by its exact title of ``least`` characters or more."""
    found = lambda c, p: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0)))
    keys = lambda doi, pmid, title: F.concat(
        F.transform(F.coalesce(found(doi, _DOI), F.array().cast("array<string>")), lambda k: F.struct(F.lit("doi").alias("leg"), k.alias("k"))),
        F.transform(F.coalesce(found(pmid, _PMID), F.array().cast("array<string>")), lambda k: F.struct(F.lit("pmid").alias("leg"), k.alias("k"))),
        F.when(F.length(title) >= least, F.array(F.struct(F.lit("title").alias("leg"), title.alias("k")))).otherwise(F.array().cast("array<struct<leg:string,k:string>>")),
    )
    p = pubs.select(whole_number(F.col("pub_id")).alias("pub"), F.inline(keys("doi", "pubmed_id", T.plain(F.col("title"))))).filter("pub is not null").distinct()
    return repos.select("repo_row_id", F.inline(keys("doi", "pubmed_id", T.plain(F.col("paper_title"))))).join(p, ["leg", "k"]).select("repo_row_id", "leg", "pub").distinct()


def _legs(spark: SparkSession, folder: str) -> DataFrame:
    return publication_legs(table(spark, folder, "ukb_dmca_repositories"), table(spark, folder, "schema19_publications"))


@register(f"{_LEGS} SELECT repo_row_id, leg, pub FROM legs")
def crosswalk_legs(spark: SparkSession, folder: str) -> DataFrame:
    return _legs(spark, folder)


@register(
    f"""{_LEGS}, l AS (SELECT DISTINCT {_KEY.format("app_id")} AS app, {_KEY.format("pub_id")} AS pub FROM schema24_pub_app_links),
    b AS (SELECT repo_row_id, min(CASE leg WHEN 'doi' THEN 1 WHEN 'pmid' THEN 2 ELSE 3 END) AS n, count(DISTINCT pub) AS pubs, count(DISTINCT app) AS apps, min(app) AS app FROM legs LEFT JOIN l USING (pub) GROUP BY repo_row_id)
    SELECT repo_row_id, ['doi', 'pmid', 'title'][n] AS best_leg, pubs, apps, CASE WHEN apps = 1 THEN 'unique' WHEN apps > 1 THEN 'several' ELSE 'none' END AS status, CASE WHEN apps = 1 THEN app END AS app FROM b"""
)
def crosswalk_applications(spark: SparkSession, folder: str) -> DataFrame:
    """The application of a row's publications if there is just one, the strongest leg, and how many there are."""
    links = table(spark, folder, "schema24_pub_app_links").select(whole_number(F.col("app_id")).alias("app"), whole_number(F.col("pub_id")).alias("pub")).distinct()
    grade = F.when(F.col("leg") == "doi", 1).when(F.col("leg") == "pmid", 2).otherwise(3)
    by = _legs(spark, folder).join(links, "pub", "left").groupBy("repo_row_id").agg(F.min(grade).alias("n"), F.count_distinct("pub").alias("pubs"), F.count_distinct("app").alias("apps"), F.min("app").alias("app"))
    status = F.when(F.col("apps") == 1, "unique").when(F.col("apps") > 1, "several").otherwise("none")
    return by.select("repo_row_id", F.element_at(F.array(*[F.lit(x) for x in ("doi", "pmid", "title")]), F.col("n")).alias("best_leg"), "pubs", "apps", status.alias("status"), F.when(F.col("apps") == 1, F.col("app")).alias("app"))


_PADDED = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@register(
    f"""WITH m AS (SELECT DISTINCT trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM (SELECT modality_family AS x FROM stage3_modality_access_matrix UNION ALL SELECT unnest(string_split(keywords, ';')) FROM schema19_publications))
    SELECT doc_id, phrase FROM documents, m WHERE phrase <> '' AND contains({_PADDED.format("text")}, ' ' || phrase || ' ')"""
)
def phrase_table_join(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and the phrases of another table that they hold: runs of words that may be phrases, joined with the phrases."""
    words = table(spark, folder, "schema19_publications").select(F.explode(F.split("keywords", ";")).alias("phrase"))
    phrases = table(spark, folder, "stage3_modality_access_matrix").select(F.col("modality_family").alias("phrase")).unionByName(words)
    return R.phrase_join(table(spark, folder, "documents").select("doc_id", "text"), "text", phrases, "phrase").select("doc_id", "phrase")


@register(
    f"""WITH c AS (SELECT DISTINCT {_KEY.format("app_id")} AS app FROM curated_application_links), r AS (SELECT DISTINCT repo_row_id, TRY_CAST(unnest(regexp_extract_all(crosswalk_app_ids, '[0-9]+')) AS BIGINT) AS app FROM ukb_dmca_repositories)
    SELECT repo_row_id, app FROM r JOIN c USING (app)"""
)
def literal_id_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose list of ids literally holds an application of another table, leading zeros aside."""
    apps = table(spark, folder, "curated_application_links").select(whole_number(F.col("app_id")).alias("app")).dropna().distinct()
    ids = table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", F.explode(F.regexp_extract_all("crosswalk_app_ids", F.lit("[0-9]+"), F.lit(0))).alias("x"))
    return ids.select("repo_row_id", F.col("x").try_cast("bigint").alias("app")).distinct().join(apps, "app").select("repo_row_id", "app")


@register(
    """WITH f AS (SELECT DISTINCT lower(repo_name) AS family, repo_row_id FROM ukb_dmca_repositories WHERE length(repo_name) >= 5), c AS (SELECT link_id, lower(linked_repo_urls) AS urls FROM curated_application_links)
    SELECT link_id, family, count(*) AS repos FROM (SELECT link_id, unnest(list_distinct(regexp_extract_all(urls, '[^/;,[:space:]]+/[^/;,[:space:]]+/([^/;,[:space:]]+)', 1))) AS family FROM c) JOIN f USING (family) GROUP BY ALL"""
)
def family_in_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Families (names of repositories) that the linked addresses of an application hold, with the number of rows of each."""
    families = table(spark, folder, "ukb_dmca_repositories").filter(F.length("repo_name") >= 5).select(F.lower("repo_name").alias("family"), "repo_row_id").distinct().groupBy("family").agg(F.count("*").alias("repos"))
    names = F.array_distinct(F.regexp_extract_all(F.lower("linked_repo_urls"), F.lit(r"[^/;,\s]+/[^/;,\s]+/([^/;,\s]+)"), F.lit(1)))
    return table(spark, folder, "curated_application_links").select("link_id", F.explode(names).alias("family")).join(families, "family").select("link_id", "family", "repos")


@register(
    """SELECT CASE WHEN lower(trim(website_match_status)) IN ('exact', 'fuzzy') THEN 'working' ELSE 'audit' END AS part, count(*) AS rows_, count(DISTINCT application_id) AS applications FROM application_level_leakage GROUP BY 1"""
)
def working_audit_split(spark: SparkSession, folder: str) -> DataFrame:
    """Rows split in two by a condition, with the sizes that both parts must have checked first."""
    apps = table(spark, folder, "application_level_leakage")
    good = F.coalesce(F.lower(F.trim("website_match_status")).isin("exact", "fuzzy"), F.lit(False))
    expected = apps.agg(F.count_if(good).alias("a"), F.count_if(~good).alias("b")).first()
    parts = R.split_with_contract(apps, good, working=expected["a"], audit=expected["b"])
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("rows_"), F.count_distinct("application_id").alias("applications"))
    return count("working", parts[0]).unionAll(count("audit", parts[1])).filter("rows_ > 0")


_SAMPLES = {"all": "true", "no first partial": "NOT first_partial", "from 1996": "period_start >= DATE '1996-01-01'", "young": "age < 8", "long at risk": "at_risk_days >= 80"}


def panel_sample(panel: DataFrame, name: str) -> DataFrame:
    """The rows of a named sample; an unknown name raises."""
    if name not in _SAMPLES:
        raise ValueError(f"no sample {name!r}; there are {', '.join(_SAMPLES)}")
    return panel.filter(_SAMPLES[name])


def _samples_sql() -> str:
    from strandwork.plans.calendar import _PANEL

    return f"WITH {_PANEL} " + " UNION ALL ".join(f"SELECT '{n}' AS sample, count(*) AS rows_, sum(n)::BIGINT AS events FROM panel WHERE {c}" for n, c in _SAMPLES.items())


@register(_samples_sql())
def panel_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and events of each named sample of the panel, counted in one pass."""
    from strandwork.plans.calendar import _panel

    one = _panel(spark, folder).agg(*[x for k, c in enumerate(_SAMPLES.values()) for x in (F.count_if(F.expr(c)).alias(f"r{k}"), F.sum(F.when(F.expr(c), F.col("n"))).alias(f"e{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("sample"), F.col(f"r{k}").alias("rows_"), F.col(f"e{k}").alias("events")) for k, n in enumerate(_SAMPLES)])))


@register("SELECT l_orderkey, l_linenumber, printf('%.3f', l_extendedprice) AS price, printf('%.2f', l_discount) AS discount FROM lineitem")
def fixed_precision(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", T.fixed(F.col("l_extendedprice"), 3).alias("price"), T.fixed(F.col("l_discount"), 2).alias("discount"))


@register("SELECT row_id, CASE WHEN regexp_matches(trim(cite_total), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN trim(cite_total)::DOUBLE END AS cites, CASE WHEN regexp_matches(trim(year_pub), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN trim(year_pub)::DOUBLE ELSE 0 END AS year FROM schema19_publications")
def safe_floats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "schema19_publications").select("row_id", T.real_or_null(F.col("cite_total")).alias("cites"), F.coalesce(T.real_or_null(F.col("year_pub")), F.lit(0.0)).alias("year"))


@register(
    """WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS fingerprint FROM documents WHERE text IS NOT NULL)
    SELECT fingerprint, count(*) AS copies, min(doc_id) AS first_doc FROM d GROUP BY fingerprint HAVING count(*) > 1"""
)
def content_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of one content, whatever their case, spacing and punctuation: a digest per text and a count per digest."""
    docs = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 256).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@register("SELECT doc_id, len(regexp_extract_all(lower(text), 'sleep[a-z]*')) AS sleep, len(regexp_extract_all(lower(text), 'heart (failure|attack)')) AS heart, len(regexp_extract_all(lower(text), '[0-9]+([.][0-9]+)?')) AS numbers FROM documents WHERE text IS NOT NULL")
def rule_hit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each rule matches, all matches counted."""
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p)).cast("bigint")
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", n("sleep[a-z]*").alias("sleep"), n("heart (failure|attack)").alias("heart"), n("[0-9]+([.][0-9]+)?").alias("numbers"))


def month_of(ordinal: Column) -> Column:
    """The first day of the month with an ordinal (12 times the year plus the month)."""
    return F.make_date(F.floor((ordinal - 1) / 12).cast("int"), F.lit(1), F.lit(1)) + F.make_interval(years=F.lit(0), months=((ordinal - 1) % 12).cast("int"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS label, date_trunc('month', o_orderdate)::DATE AS first_day FROM orders")
def ordinal_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """From a day to its month's ordinal and back."""
    d = F.to_date("o_orderdate")
    back = month_of(F.year(d) * 12 + F.month(d)).cast("date")
    return table(spark, folder, "orders").select("o_orderkey", F.date_format(back, "yyyy-MM").alias("label"), back.alias("first_day"))
