"""Queries of the general problems: packed values, orphan references, timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators.references import existence_deltas, orphan_references, standing_orphans, whole_number
from strandwork.operators.split_values import infer_rules, split_values
from strandwork.operators.timestamps import normalise_timestamps
from strandwork.plans.packed_sql import P3_FOUND
from strandwork.sources.tables import table


def packed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, row_key, field_name, cell) of every field that may hold several values."""
    fields = ("doi", "pubmed_id", "crosswalk_app_ids")
    repos = table(spark, folder, "ukb_dmca_repositories").select(
        F.lit("ukb_dmca_repositories").alias("table_name"),
        F.col("repo_row_id").cast("string").alias("row_key"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("cell")) for c in fields])),
    )
    matrix = table(spark, folder, "stage3_modality_access_matrix").select(
        F.lit("stage3_modality_access_matrix").alias("table_name"),
        F.col("modality_family").alias("row_key"),
        F.lit("source_urls").alias("field_name"),
        F.col("source_urls").alias("cell"),
    )
    return repos.unionByName(matrix).filter(F.col("cell").isNotNull())


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    cells = packed_cells(spark, folder)
    return split_values(cells, "field_name", "cell", at_least=2).select("table_name", "row_key", "field_name", "pos", "item_value")


def p3_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What was inferred of each source, with the score of each candidate delimiter."""
    rules = infer_rules(packed_cells(spark, folder), "field_name", "cell")
    rows = [(r.source, r.kind, d, s, d in r.delimiters) for r in rules.values() for d, s in r.scores]
    return spark.createDataFrame(rows, "field_name string, value_type string, delimiter string, score double, accepted boolean")


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(ref_table, ref_field, ref_row_id, target, key, period), one row per referring row and key."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    links = table(spark, folder, "schema24_pub_app_links").select(
        F.lit("schema24_pub_app_links").alias("ref_table"),
        F.col("link_id").alias("ref_row_id"),
        month("linked_on").alias("period"),
        F.inline(F.array(
            F.struct(F.lit("app_id").alias("ref_field"), F.lit("application").alias("target"), whole_number(F.col("app_id")).alias("key")),
            F.struct(F.lit("pub_id").alias("ref_field"), F.lit("publication").alias("target"), whole_number(F.col("pub_id")).alias("key")),
        )),
    )
    curated = table(spark, folder, "curated_application_links").select(
        F.lit("curated_application_links").alias("ref_table"),
        F.col("link_id").alias("ref_row_id"),
        month("first_dmca_notice_date").alias("period"),
        F.lit("app_id").alias("ref_field"),
        F.lit("application").alias("target"),
        whole_number(F.col("app_id")).alias("key"),
    )
    ids = F.array_distinct(F.transform(F.regexp_extract_all(F.col("crosswalk_pub_ids"), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), whole_number))
    repos = table(spark, folder, "ukb_dmca_repositories").select(
        F.lit("ukb_dmca_repositories").alias("ref_table"),
        F.col("repo_row_id").alias("ref_row_id"),
        month("notice_date").alias("period"),
        F.lit("crosswalk_pub_ids").alias("ref_field"),
        F.lit("publication").alias("target"),
        F.explode(ids).alias("key"),
    )
    return links.unionByName(curated).unionByName(repos).filter(F.col("key").isNotNull())


def held_keys(spark: SparkSession, folder: str) -> DataFrame:
    apps, pubs = table(spark, folder, "stage2_master_projects"), table(spark, folder, "schema19_publications")
    return existence_deltas(apps, "application", whole_number(F.col("app_id")), F.col("deleted_at")).unionByName(
        existence_deltas(pubs, "publication", whole_number(F.col("pub_id")), F.col("deleted_at"))
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphan_references(references(spark, folder), held_keys(spark, folder))
    return found.select("ref_table", "ref_field", "ref_row_id", F.col("key").alias("missing_key"), "period")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references and the keys they miss, per table, field and month."""
    return p4_found(spark, folder).groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("orphan_refs"), F.countDistinct("missing_key").alias("missing_keys"))


def change_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """(target, key, period, existing, referring): each arrival, deletion and reference as a signed change of its month."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    parts = [references(spark, folder).select("target", "key", "period", zero.alias("existing"), one.alias("referring"))]
    for name, key, target in (("stage2_master_projects", "app_id", "application"), ("schema19_publications", "pub_id", "publication")):
        changes = F.array_compact(F.array(F.struct(month("loaded_at").alias("period"), one.alias("existing")), F.when(F.col("deleted_at").isNotNull(), F.struct(F.greatest(month("deleted_at"), month("loaded_at")).alias("period"), (-one).alias("existing")))))
        parts.append(table(spark, folder, name).select(F.lit(target).alias("target"), whole_number(F.col(key)).alias("key"), F.inline(changes)).select("target", "key", "period", "existing", zero.alias("referring")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("key").isNotNull())


def p4_standing(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan keys standing at the end of each month, maintained from the changes of the months."""
    return standing_orphans(change_deltas(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    no = F.lit(None).cast("string")
    repos = table(spark, folder, "ukb_dmca_repositories").select(
        F.lit("ukb_dmca_repositories").alias("table_name"),
        F.col("repo_row_id").alias("row_id"),
        F.inline(F.array(
            F.struct(F.lit("earliest_observed_offending_file_commit_date").alias("field_name"), F.col("earliest_observed_offending_file_commit_date").alias("value"), F.col("commit_zone").alias("zone"), no.alias("locale")),
            F.struct(F.lit("wayback_first_capture").alias("field_name"), F.col("wayback_first_capture").alias("value"), no.alias("zone"), no.alias("locale")),
        )),
    )
    apps = table(spark, folder, "application_level_leakage").select(
        F.lit("application_level_leakage").alias("table_name"),
        "row_id",
        F.lit("project_start_date").alias("field_name"),
        F.col("project_start_date").alias("value"),
        F.col("entry_zone").alias("zone"),
        F.col("entry_locale").alias("locale"),
    )
    values = repos.unionByName(apps).filter(F.col("value").isNotNull())
    return normalise_timestamps(values, "value", "zone", "locale").filter("utc_us is not null").select("table_name", "row_id", "field_name", "utc_us")


QUERIES = {"p3_found": p3_found, "p3_rules": p3_rules, "p4_found": p4_found, "p4_report": p4_report, "p4_standing": p4_standing, "p7_found": p7_found}

_KEY = r"TRY_CAST(regexp_extract({0}, '^\s*([+-]?[0-9]+)(\.0*)?\s*$', 1) AS BIGINT)"
_P4 = f"""
WITH refs AS (
  SELECT 'schema24_pub_app_links' AS ref_table, 'app_id' AS ref_field, link_id AS ref_row_id, 'a' AS t, {_KEY.format("app_id")} AS k, strftime(linked_on, '%Y-%m') AS period FROM schema24_pub_app_links
  UNION ALL SELECT 'schema24_pub_app_links', 'pub_id', link_id, 'p', {_KEY.format("pub_id")}, strftime(linked_on, '%Y-%m') FROM schema24_pub_app_links
  UNION ALL SELECT 'curated_application_links', 'app_id', link_id, 'a', {_KEY.format("app_id")}, strftime(first_dmca_notice_date, '%Y-%m') FROM curated_application_links
  UNION ALL SELECT DISTINCT 'ukb_dmca_repositories', 'crosswalk_pub_ids', repo_row_id, 'p', {_KEY.format("x")}, strftime(notice_date, '%Y-%m')
    FROM (SELECT repo_row_id, notice_date, unnest(regexp_extract_all(crosswalk_pub_ids, '[0-9]+(\\.[0-9]+)?')) AS x FROM ukb_dmca_repositories)
), held AS (
  SELECT 'a' AS t, {_KEY.format("app_id")} AS k FROM stage2_master_projects WHERE deleted_at IS NULL
  UNION SELECT 'p', {_KEY.format("pub_id")} FROM schema19_publications WHERE deleted_at IS NULL
), found AS (
  SELECT ref_table, ref_field, ref_row_id, k AS missing_key, period FROM refs r
  WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM held h WHERE h.t = r.t AND h.k = r.k)
)"""
ORACLE_SQL = {
    "p3_found": P3_FOUND,
    "p4_found": f"{_P4} SELECT * FROM found",
    "p4_standing": f"""{_P4}, d AS (
  SELECT CASE t WHEN 'a' THEN 'application' ELSE 'publication' END AS target, k, coalesce(period, '') AS period, 0 AS ex, 1 AS ref FROM refs WHERE k IS NOT NULL
  UNION ALL SELECT 'application', {_KEY.format("app_id")}, coalesce(strftime(loaded_at, '%Y-%m'), ''), 1, 0 FROM stage2_master_projects
  UNION ALL SELECT 'application', {_KEY.format("app_id")}, greatest(strftime(deleted_at, '%Y-%m'), strftime(loaded_at, '%Y-%m')), -1, 0 FROM stage2_master_projects WHERE deleted_at IS NOT NULL
  UNION ALL SELECT 'publication', {_KEY.format("pub_id")}, coalesce(strftime(loaded_at, '%Y-%m'), ''), 1, 0 FROM schema19_publications
  UNION ALL SELECT 'publication', {_KEY.format("pub_id")}, greatest(strftime(deleted_at, '%Y-%m'), strftime(loaded_at, '%Y-%m')), -1, 0 FROM schema19_publications WHERE deleted_at IS NOT NULL
), p AS (SELECT target, k, period, sum(ex) AS ex, sum(ref) AS ref FROM d WHERE k IS NOT NULL GROUP BY ALL),
o AS (SELECT target, k, period, (sum(ref) OVER w > 0 AND sum(ex) OVER w <= 0)::INT AS o FROM p WINDOW w AS (PARTITION BY target, k ORDER BY period)),
c AS (SELECT target, period, sum(o - coalesce(l, 0)) AS c FROM (SELECT *, lag(o) OVER (PARTITION BY target, k ORDER BY period) AS l FROM o) GROUP BY ALL)
SELECT target, period, sum(c) OVER (PARTITION BY target ORDER BY period)::BIGINT AS orphan_keys FROM c""",
    "p4_report": f"{_P4} SELECT ref_table, ref_field, period, count(*) AS orphan_refs, count(DISTINCT missing_key) AS missing_keys FROM found GROUP BY ALL",
}
