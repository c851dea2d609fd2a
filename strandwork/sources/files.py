"""Scans of delimited, multi-line, compressed, Markdown, HTML and JSON files, everything as text."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwork.session import cut


def sniff_separator(sample: str) -> str:
    """The separator that the whole lines of the first 4,096 characters hold most evenly, then most often; a comma if there is none."""
    lines = [x for x in sample[:4096].split("\n") if x.strip()]
    if len(sample) > 4096 and len(lines) > 1:
        lines = lines[:-1]  # the last one is cut
    counts = {sep: [x.count(sep) for x in lines] for sep in "\t,;|"}
    found = {sep: n for sep, n in counts.items() if n and n[0]}
    return max(found, key=lambda sep: (sum(k == found[sep][0] for k in found[sep]), found[sep][0], sep == "\t"), default=",")


def scan_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8", required: tuple[str, ...] = (), multiline: bool = True, header: tuple[str, ...] | None = None) -> DataFrame:
    """A delimited file with a header; every column is text, blanks stay blanks and bad bytes become U+FFFD.

    Quoted fields may hold line breaks, for which a file is read by one task; without them ``multiline=False`` splits large files.
    ``header`` names the columns of files without one. Without ``sep`` the first lines decide. Missing ``required`` columns
    raise, a missing file gives the error of the reader.
    """
    if sep is None:
        first = spark.read.option("encoding", encoding).text(path).limit(50).collect()
        sep = sniff_separator("\n".join(r[0] for r in first))
    reader = spark.read if header is None else spark.read.schema(", ".join(f"`{c}` string" for c in header))
    df = reader.csv(path, header=header is None, sep=sep, encoding=encoding, multiLine=multiline, escape='"', inferSchema=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns if c.startswith("\ufeff")})
    df = df.select(*[F.coalesce(f"`{c}`", F.lit("")).alias(c) for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {', '.join(missing)}")
    return df


def scan_multiline_records(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """Tab-separated records whose last field runs over unquoted line breaks: a line that begins with digits and a tab opens a record.

    Lines before the first record are dropped but for the header. Records that lack fields are padded with blanks; white
    space in the last field becomes one blank, as line breaks do. Files are split as any text: the lines of a split count its records, the
    splits before it (one row each) say with which record it begins, and only the lines of one record come together.
    """
    lines = spark.read.option("encoding", encoding).text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    marked = cut(lines.withColumn("opens", F.col("line").rlike(r"^\d+\t").cast("int")))
    splits = marked.groupBy("f", "b").agg(F.sum("opens").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("opens").over(Window.partitionBy("f", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    numbered = marked.withColumn("n", inside).join(splits.select("f", "b", before.alias("before")), ["f", "b"]).withColumn("record", F.col("before") + F.col("n")).filter("record > 0")
    whole = numbered.repartitionByRange("f", "record").groupBy("f", "record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "i", "line"))), lambda x: x["line"]), "\n").alias("text")).sortWithinPartitions("f", "record")
    parts = F.split("text", "\t", len(columns))
    return whole.select(*[F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(c) if k < len(columns) - 1 else F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), r"(?U)\s+", " ")).alias(c) for k, c in enumerate(columns)])


def field_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(position, field, type, nullable) of the columns of a table's files; only their footers are read."""
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame([(n, f.name, f.dataType.simpleString(), f.nullable) for n, f in enumerate(fields, 1)], "position int, field string, type string, nullable boolean")


def scan_packed(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text) of plain, ``.gz`` and ``.zip`` files; of an archive its first text, else its first member that isn't hidden."""

    def unpack(name: str, content: bytes) -> tuple[str, str]:
        if name.endswith(".gz"):
            return name.rsplit("/", 1)[-1][:-3], gzip.decompress(content).decode("utf-8", "replace")
        if name.endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                members = [m for m in z.namelist() if not m.endswith("/") and not m.rsplit("/", 1)[-1].startswith(".")]
                texts = [m for m in members if m.lower().endswith((".txt", ".tsv", ".csv"))]
                chosen = (texts or members or [""])[0]
                return chosen, z.read(chosen).decode("utf-8", "replace") if chosen else ""
        return name.rsplit("/", 1)[-1], content.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            out = [unpack(p, c) for p, c in zip(paths, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["path", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, name string, text string")


def scan_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of all files of a folder tree whose names fit ``pattern``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def html_rows(pages: DataFrame, html: str, heading: str = r"<h2>[^<]*Applications[^<]*</h2>") -> DataFrame:
    """(…, pos, id, title) of the table rows behind a heading of each page: the number of the first link, and the last cell as text.

    The first row of each id and page counts; pages without the heading give none.
    """
    keep = [c for c in pages.columns if c != html]
    part = F.regexp_extract(html, rf"(?is){heading}(.*?)(?:<h2|$)", 1)
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(part, F.lit(r"(?is)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("pos", "row"))
    number = F.coalesce(F.nullif(F.regexp_extract("row", r"\bid=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract("row", r"id=\"a(\d+)\"", 1), F.lit("")))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    title = F.trim(F.regexp_replace(F.regexp_replace(F.try_element_at(cells, F.lit(-1)), r"<[^<>]*>", " "), r"\s+", " "))
    found = rows.select(*keep, "pos", number.try_cast("bigint").alias("id"), title.alias("title")).filter("id is not null")
    first = Window.partitionBy(*keep, "id").orderBy("pos")
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def scan_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """JSON documents, one a file or (``multiline=False``, split over tasks) one a line, with a given schema; what doesn't parse gives nulls."""
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).option("mode", "PERMISSIVE").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def replay_responses(requests: DataFrame, cache: DataFrame, url: str = "url") -> DataFrame:
    """Requests with what a staged table (url, status, body, fetched_at) holds for them; nothing is fetched.

    The latest response counts, failures (status 0) don't, and a request without one has nulls.
    """
    kept = cache.filter("status > 0").groupBy("url").agg(F.max_by(F.struct("status", "body", "fetched_at"), F.struct("fetched_at", "status")).alias("r"))
    return requests.join(kept.withColumnRenamed("url", url), url, "left").select(*requests.columns, "r.status", "r.body", "r.fetched_at")
