"""Queries of text, identifier, address and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import text as T
from strandwork.plans.registry import Register
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_PLAIN = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{s}'" for s in T.STOP_WORDS) + "]"


def _tokens(c: str, least: int = 3) -> str:
    found = f"regexp_extract_all(lower(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]{{{least},}}')"
    return f"[x FOR x IN {found} IF NOT list_contains({_STOP}, x)]"


@register("SELECT row_id, CASE WHEN lower(trim(notes)) NOT IN ('', 'nan', 'na', 'n/a', 'none') THEN trim(notes) END AS notes, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, CASE WHEN regexp_matches(trim(app_id), '^[+-]?[0-9]+$') THEN trim(app_id)::BIGINT ELSE 0 END AS app FROM stage2_master_projects")
def cleaned_fields(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stage2_master_projects").select("row_id", T.blank_to_null(F.col("notes")).alias("notes"), T.squash(F.col("title")).alias("title"), F.coalesce(T.whole_or_zero(F.col("app_id")), F.lit(0)).alias("app"))


@register(f"SELECT row_id, {_PLAIN.format('title')} AS title FROM schema19_publications")
def normalize_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "schema19_publications").select("row_id", T.plain(F.col("title")).alias("title"))


_PAIRS = "replace(replace(replace(replace(replace(lower({0}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'þ', 'th'), 'ð', 'd')"


@register(f"SELECT repo_row_id, {_PLAIN.format('strip_accents(' + _PAIRS.format('repo_owner_public_name') + ')')} AS name FROM ukb_dmca_repositories")
def ascii_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", T.ascii_plain(F.col("repo_owner_public_name")).alias("name"))


@register(f"SELECT row_id, array_to_string(list_sort(list_distinct({_tokens('application_title')})), ' ') AS tokens FROM application_level_leakage")
def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "application_level_leakage").select("row_id", F.array_join(F.array_sort(F.array_distinct(T.tokens(F.col("application_title")))), " ").alias("tokens"))


_KEYED = "TRY_CAST(regexp_extract(app_id, '^\\s*([0-9]+)', 1) AS BIGINT)"


@register(
    f"""WITH p AS (SELECT {_KEYED} AS k, max(title) AS title FROM stage2_master_projects GROUP BY 1), t AS (SELECT c.link_id, list_distinct({_tokens("c.application_title")}) AS a, list_distinct({_tokens("p.title")}) AS b FROM (SELECT *, {_KEYED} AS k FROM curated_application_links) c JOIN p USING (k))
    SELECT link_id, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0), 6) AS overlap FROM t WHERE a IS NOT NULL AND b IS NOT NULL"""
)
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    key = F.regexp_extract("app_id", r"^\s*([0-9]+)", 1).try_cast("bigint").alias("k")
    register_ = table(spark, folder, "stage2_master_projects").select(key, "title").groupBy("k").agg(F.max("title").alias("title"))
    both = table(spark, folder, "curated_application_links").select("link_id", key, "application_title").join(register_, "k").filter("application_title is not null and title is not null")
    return both.select("link_id", F.round(T.overlap(T.tokens(F.col("application_title")), T.tokens(F.col("title"))), 6).alias("overlap"))


@register(r"SELECT doc_id, regexp_extract(text, '([0-9]+) participants', 1) AS participants, len(regexp_extract_all(lower(text), 'cohort')) AS cohort_hits, regexp_matches(lower(text), 'cohort.{0,140}platform|platform.{0,140}cohort') AS near FROM documents WHERE text IS NOT NULL")
def rule_match(spark: SparkSession, folder: str) -> DataFrame:
    """Positions and proximity as bounded-gap patterns: two words within 140 characters of each other."""
    low = F.lower("text")
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.regexp_extract("text", "([0-9]+) participants", 1).alias("participants"), F.regexp_count(low, F.lit("cohort")).cast("bigint").alias("cohort_hits"), low.rlike("cohort.{0,140}platform|platform.{0,140}cohort").alias("near"))


@register(
    """WITH h AS (SELECT doc_id, text, strpos(text, 'platform') AS p FROM documents WHERE contains(text, 'platform')), w AS (SELECT *, greatest(p - 30, 1) AS a, least(p + 38, length(text) + 1) AS b FROM h)
    SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substr(text, a::INT, (b - a)::INT) || CASE WHEN b <= length(text) THEN '...' ELSE '' END AS snippet FROM w"""
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "documents").filter(F.contains("text", F.lit("platform")))
    return hits.select("doc_id", T.snippet(F.col("text"), F.instr("text", "platform"), 8, 30).alias("snippet"))


@register(r"SELECT repo_row_id, array_to_string(list_distinct([regexp_replace(x, '[.,;:)]+$', '') FOR x IN regexp_extract_all(doi, '10\.[0-9]{4,9}/[^\s\x22<>|]+')]).list_sort(), ' ') AS dois, len(regexp_extract_all(coalesce(crosswalk_app_ids, ''), '[0-9]{2,8}')) AS ids FROM ukb_dmca_repositories WHERE doi IS NOT NULL")
def identifier_lists(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.size(F.regexp_extract_all(F.coalesce("crosswalk_app_ids", F.lit("")), F.lit("[0-9]{2,8}"), F.lit(0))).cast("bigint")
    return table(spark, folder, "ukb_dmca_repositories").filter("doi is not null").select("repo_row_id", F.array_join(F.array_sort(T.identifiers(F.col("doi"), "doi")), " ").alias("dois"), ids.alias("ids"))


@register(
    r"""SELECT repo_row_id, regexp_extract(u, '^(?:https?://)?([a-z0-9.-]+)/', 1) AS host, regexp_extract(u, '/(blob|tree)/([^/]+)/', 1) AS scope, regexp_extract(u, '/(?:blob|tree)/([^/?#]+)', 1) AS ref, regexp_extract(u, '/(?:blob)/[^/]+/([^?#]+)', 1) AS path, regexp_extract(u, '[?]([^#]+)', 1) AS query
    FROM (SELECT repo_row_id, trim(repo_url) AS u FROM ukb_dmca_repositories)"""
)
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.trim("repo_url")
    part = lambda p: F.regexp_extract(u, p, 1)
    return table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", part(r"^(?:https?://)?([a-z0-9.-]+)/").alias("host"), part(r"/(blob|tree)/([^/]+)/").alias("scope"), part(r"/(?:blob|tree)/([^/?#]+)").alias("ref"), part(r"/(?:blob)/[^/]+/([^?#]+)").alias("path"), part(r"[?]([^#]+)").alias("query"))


@register(
    """SELECT repo_row_id, CASE WHEN length(k) >= 6 AND k NOT IN ('project', 'analysis', 'research') THEN k END AS project_key, md5(lower(coalesce(offending_file_path, ''))) AS fingerprint FROM (SELECT repo_row_id, offending_file_path, regexp_replace(lower(repo_name), '[^a-z0-9]+', '', 'g') AS k FROM ukb_dmca_repositories)"""
)
def project_keys(spark: SparkSession, folder: str) -> DataFrame:
    k = F.regexp_replace(F.lower("repo_name"), "[^a-z0-9]+", "")
    return table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", F.when((F.length(k) >= 6) & ~k.isin("project", "analysis", "research"), k).alias("project_key"), F.md5(F.lower(F.coalesce("offending_file_path", F.lit("")))).alias("fingerprint"))


@register(
    r"""SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^<>]+>', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*`#>]+', '', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM documents WHERE text IS NOT NULL"""
)
def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", T.strip_markup(F.col("text")).alias("plain"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def kv_json_extract(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").alias("k_text"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("SELECT n_nationkey, '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS payload FROM nation")
def json_payload(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("payload"))


@register("SELECT p_partkey, to_base64(encode(p_name)) AS packed, p_name AS unpacked FROM part")
def base64_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    packed = F.base64(F.encode("p_name", "UTF-8"))
    return table(spark, folder, "part").select("p_partkey", packed.alias("packed"), F.decode(F.unbase64(packed), "UTF-8").alias("unpacked"))


@register(
    """WITH w AS (SELECT repo_row_id, lower(repo_owner_public_name) AS n, regexp_extract_all(lower(coalesce(paper_authors, '')), '[a-z]+') AS ws FROM ukb_dmca_repositories WHERE repo_owner_public_name IS NOT NULL), p AS (SELECT *, regexp_extract_all(n, '[a-z]+') AS parts FROM w)
    SELECT repo_row_id, coalesce(list_contains(ws, parts[-1]) AND (list_contains(ws, parts[1]) OR list_contains(ws, parts[1][1])), false) AS named FROM p"""
)
def owner_among_authors(spark: SparkSession, folder: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("paper_authors", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return table(spark, folder, "ukb_dmca_repositories").filter("repo_owner_public_name is not null").select("repo_row_id", T.name_in_tokens(F.col("repo_owner_public_name"), words).alias("named"))


_RULES = [("percent", "[0-9.]+ per cent"), ("cohort size", "[0-9,]+ participants"), ("year", "20[0-9]{2}")]


@register(
    "SELECT doc_id, rule, position::INT AS position, hit FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS o, '{n}' AS rule, strpos(text, regexp_extract(text, '{p}')) AS position, regexp_extract(text, '{p}') AS hit FROM documents WHERE regexp_matches(text, '{p}')" for i, (n, p) in enumerate(_RULES)) + ")"
)
def ordered_rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.inline(T.rule_hits(F.col("text"), _RULES)))
    return hits.select("doc_id", "rule", "position", "hit")
