"""Problem 6: one group identifier for all rows tied by lineage or repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.addresses import SQL_UNKNOWN, known, repository, sql_repository
from strandwork.llm.components import connected_components, star_edges
from strandwork.sources.tables import table


def memberships(repos: DataFrame) -> DataFrame:
    """(repo_row_id, key): the lineage and the repositories that each row names, "not known" left out."""
    keys = F.array(
        F.concat(F.lit("l:"), known(F.col("lineage_id"))),
        F.concat(F.lit("r:"), repository(F.col("repo_url"))),
        F.concat(F.lit("r:"), repository(F.col("parent_or_source_repo"))),
    )
    return repos.select("repo_row_id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members = memberships(table(spark, folder, "ukb_dmca_repositories"))
    groups = connected_components(star_edges(members, "repo_row_id", "key"))
    return groups.select(F.col("node").alias("repo_row_id"), F.col("group").alias("group_id"))


def p6_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups there are of each size."""
    return p6_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


QUERIES = {"p6_found": p6_found, "p6_sizes": p6_sizes}

_GROUPS = f"""
WITH RECURSIVE m AS (
  SELECT DISTINCT repo_row_id AS id, k FROM (
    SELECT repo_row_id, CASE WHEN lower(trim(lineage_id)) NOT IN {SQL_UNKNOWN} THEN 'l:' || lower(trim(lineage_id)) END AS k FROM ukb_dmca_repositories
    UNION ALL SELECT repo_row_id, 'r:' || {sql_repository("repo_url")} FROM ukb_dmca_repositories
    UNION ALL SELECT repo_row_id, 'r:' || {sql_repository("parent_or_source_repo")} FROM ukb_dmca_repositories
  ) WHERE k IS NOT NULL
), s AS (SELECT k, min(id) AS lo FROM m GROUP BY k),
e AS (SELECT DISTINCT m.id AS a, s.lo AS b FROM m JOIN s USING (k)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (
  SELECT DISTINCT a AS id, a AS reached FROM g
  UNION
  SELECT w.id, g.b FROM walk w JOIN g ON g.a = w.reached
), c AS (SELECT id, min(reached) AS group_id, count(*) AS n FROM walk GROUP BY id)
"""
ORACLE_SQL = {
    "p6_found": f"{_GROUPS} SELECT id AS repo_row_id, group_id FROM c WHERE n > 1",
    "p6_sizes": f"{_GROUPS} SELECT size, count(*) AS groups FROM (SELECT group_id, count(*) AS size FROM c WHERE n > 1 GROUP BY group_id) GROUP BY size",
}
