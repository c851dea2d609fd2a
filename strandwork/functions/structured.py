"""Searches in JSON texts and merges of maps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_keys(df: DataFrame, text: str, keys: tuple[str, ...], out: str = "found", limit: int | None = None) -> DataFrame:
    """``out``: all texts (the first ``limit`` if one is given) under any of ``keys`` at any depth of a JSON text, depth first; names are compared without case, blanks, ``_`` and ``-``.

    What isn't JSON, or null, gives an empty list.
    """
    norm = lambda k: "".join(c for c in k.lower() if c.isalnum())
    wanted = {norm(k) for k in keys}

    def walk(node, into: list[str]) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                if norm(k) in wanted and not isinstance(v, (dict, list)) and v is not None and (limit is None or len(into) < limit):
                    into.append(v if isinstance(v, str) else json.dumps(v))
                walk(v, into)
        elif isinstance(node, list):
            for v in node:
                walk(v, into)

    def search(t: str | None) -> list[str]:
        into: list[str] = []
        try:
            walk(json.loads(t), into)
        except (TypeError, ValueError, RecursionError):
            pass
        return into

    source = df.drop(out) if out != text else df
    schema = source.select("*", F.lit(None).cast("array<string>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([search(t) for t in texts], pa.list_(pa.string()))], names=[*batch.schema.names, out])

    return source.mapInArrow(run, schema)


def merge_maps(a: Column, b: Column) -> Column:
    """Right-biased merge: values of ``b`` replace those of ``a``, blanks included; a null map counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


# How citation and package files name what they say.
_CLUES = {"title": r"title", "doi": r"doi", "authors": r"authors?(?:@r)?", "url": r"(?:url|repository-code|homepage)", "version": r"version"}


def paper_clues(text: Column) -> Column:
    """Map of title, doi, authors, url and version from lines ``name: value`` of citation and package files; the first line of each name counts."""
    pairs = []
    for name, pattern in _CLUES.items():
        value = F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?im)^\s*[-\"']?{pattern}[\"']?\s*[:=]\s*(.+?)\s*,?$", 1), r"^[\"']+|[\"']+$", ""))
        pairs.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"] != ""))
