"""Queries that write tables to the shared folder in every form, read them back and return what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.plans.registry import Register
from strandwork.session import shared_folder
from strandwork.sources import files, sinks
from strandwork.sources.tables import table

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/exchange-{name}-{uuid.uuid4().hex}"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


@register("SELECT row_id::VARCHAR AS row_id, coalesce(title, '') AS title, coalesce(institution, '') AS institution, coalesce(notes, '') AS notes FROM stage2_master_projects")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited text with quotes and line breaks, columns in a fixed order."""
    path = _place(spark, "csv")
    sinks.write_delimited(table(spark, folder, "stage2_master_projects"), path, ["row_id", "title", "institution", "notes"])
    return files.scan_delimited(spark, path, sep=",", required=("row_id", "title"))


@register("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def tsv_sniffed_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated text whose delimiter is found by the scan, split over tasks as it holds no quoted line breaks."""
    path = _place(spark, "tsv")
    table(spark, folder, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value")).orderBy("value").coalesce(1).write.option("header", "false").text(path)
    # the header is a line of its own in its own, first file
    spark.createDataFrame([("n_nationkey\tn_name\tn_regionkey",)], "value string").coalesce(1).write.mode("append").text(path)
    rows = files.scan_delimited(spark, path, multiline=False, header=("n_nationkey", "n_name", "n_regionkey"))
    return rows.filter("n_nationkey <> 'n_nationkey'")


@register("SELECT repo_row_id::VARCHAR AS repo_row_id, coalesce(repo_owner_public_name, '') AS name FROM ukb_dmca_repositories WHERE NOT regexp_matches(coalesce(repo_owner_public_name, ''), '[^\\x00-\\xFF]')")
def latin1_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Text in Latin-1; names with letters beyond it can't be written so and are another table's matter."""
    path = _place(spark, "latin1")
    named = table(spark, folder, "ukb_dmca_repositories").select("repo_row_id", F.coalesce("repo_owner_public_name", F.lit("")).alias("name")).filter(~F.col("name").rlike(r"[^\x00-\xFF]"))
    named.write.csv(path, header=True, encoding="ISO-8859-1", escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.scan_delimited(spark, path, sep=",", encoding="ISO-8859-1")


@register("SELECT application_id::VARCHAR AS app_id, count(*) AS copies, min(trim(regexp_replace(coalesce(application_title, '') || ' second line', '\\s+', ' ', 'g'))) AS title FROM application_level_leakage GROUP BY 1")
def multiline_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose last field runs over unquoted line breaks."""
    path = _place(spark, "lines")
    rows = table(spark, folder, "application_level_leakage").select(F.concat(F.col("application_id").cast("string"), F.lit("\t"), _text("application_title"), F.lit("\nsecond line")).alias("value"))
    rows.write.text(path)
    return files.scan_multiline_records(spark, path, ["app_id", "title"]).groupBy("app_id").agg(F.count("*").alias("copies"), F.min("title").alias("title"))


@register("SELECT event_id, event_type, user_id FROM events")
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    path = _place(spark, "json")
    sinks.write_json(table(spark, folder, "events").select("event_id", "event_type", "user_id"), path)
    return files.scan_json(spark, path, "event_id bigint, event_type string, user_id bigint", multiline=False)


@register("SELECT n_regionkey, n_name FROM nation")
def entity_files_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of lines per entity."""
    path = _place(spark, "entity")
    sinks.write_per_entity(table(spark, folder, "nation"), "n_regionkey", "n_name", path)
    return spark.read.schema("value string, n_regionkey int").text(path).select("n_regionkey", F.col("value").alias("n_name"))


@register("SELECT r_name || '.md' AS name, '# ' || r_name || chr(10) || r_regionkey AS text FROM region")
def markdown_folder_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree by pattern; each region's notice lies in a folder of its own."""
    path = _place(spark, "markdown")
    fs = spark._jvm.org.apache.hadoop.fs
    for r in table(spark, folder, "region").collect():  # the fixed table of regions
        at = fs.Path(f"{path}/{r['r_regionkey']}/{r['r_name']}.md")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(f"# {r['r_name']}\n{r['r_regionkey']}".encode()))
        out.close()
    return files.scan_texts(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "text")


@register("SELECT DISTINCT ON (application_id) application_id AS id, n FROM (SELECT application_id, count(*) OVER (PARTITION BY application_id) AS n FROM application_level_leakage)")
def html_pages_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a table of linked applications, one page per application, read back as rows."""
    apps = table(spark, folder, "application_level_leakage").groupBy("application_id").agg(F.count("*").alias("n"))
    page = F.format_string("<h1>x</h1><h2>1 Applications</h2><table><tr><td><a href='app.cgi?id=%d'>%d</a></td><td><b>%d</b></td></tr></table><h2>Other</h2>", "application_id", "application_id", "n")
    return files.html_rows(apps.select(page.alias("html")), "html").select("id", F.col("title").cast("bigint").alias("n"))


@register("SELECT r_name, r_regionkey::VARCHAR AS r_regionkey, '' AS note FROM region")
def preferred_columns_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Preferred columns first, then the others as found, blanks for one that isn't there."""
    path = _place(spark, "preferred")
    region = table(spark, folder, "region")
    sinks.write_delimited(region, path, sinks.preferred_order(region, ["r_name", "note"]))
    return files.scan_delimited(spark, path, sep=",")


@register("SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region UNION ALL SELECT '| r_regionkey | r_name |' UNION ALL SELECT '| --- | --- |'")
def markdown_rows(spark: SparkSession, folder: str) -> DataFrame:
    text = sinks.markdown_table(table(spark, folder, "region").orderBy("r_regionkey"), ["r_regionkey", "r_name"])
    return spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


@register("SELECT 'variable' AS kind, count(*) AS fields FROM (DESCRIBE ukb_dmca_repositories) UNION ALL SELECT 'text', count(*) FILTER (column_type = 'VARCHAR') FROM (DESCRIBE ukb_dmca_repositories)")
def field_catalogue_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over the catalogue of a table's fields."""
    fields = files.field_catalogue(spark, f"{folder}/ukb_dmca_repositories.parquet")
    return fields.agg(F.count("*").alias("v"), F.count_if(F.col("type") == "string").alias("t")).select(F.inline(F.array(F.struct(F.lit("variable").alias("kind"), F.col("v").alias("fields")), F.struct(F.lit("text").alias("kind"), F.col("t").alias("fields")))))


@register("SELECT sha256('x' || r_name) AS sha256, 1 + length(r_name) AS bytes FROM region")
def digests_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Provenance digests of files as they lie in the shared folder."""
    path = _place(spark, "digest")
    fs = spark._jvm.org.apache.hadoop.fs
    for r in table(spark, folder, "region").collect():  # the fixed table of regions
        at = fs.Path(f"{path}/{r['r_regionkey']}.txt")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(f"x{r['r_name']}".encode()))
        out.close()
    return files.file_digests(spark, path).select("sha256", "bytes")


@register("SELECT o_orderkey % 7 AS url_key, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def replayed_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Requests answered from a staged table of responses: the latest one that isn't a failure."""
    orders = table(spark, folder, "orders")
    url = F.concat(F.lit("u"), (F.col("o_orderkey") % 7).cast("string"))
    kept = orders.select(url.alias("url"), F.lit(200).alias("status"), F.col("o_orderkey").cast("string").alias("body"), F.timestamp_seconds("o_orderkey").alias("fetched_at"))
    failed = orders.select(url.alias("url"), F.lit(0).alias("status"), F.lit("no").alias("body"), F.timestamp_seconds(F.col("o_orderkey") + 10**9).alias("fetched_at"))
    asked = spark.range(7).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("id").alias("url_key"))
    return files.replay_responses(asked, kept.unionByName(failed)).filter("status is not null").select("url_key", F.col("body").cast("bigint").alias("latest"))
