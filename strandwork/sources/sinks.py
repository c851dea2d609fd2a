"""Writers: delimited text with a fixed column order, JSON, Markdown and coefficient tables, one file per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_delimited(df: DataFrame, path: str, columns: list[str] | None = None, strict: bool = False, files: int | None = None, mode: str = "overwrite") -> None:
    """Columns in the given order, blanks for nulls and NaN; missing ones are filled with blanks, extra ones dropped or (``strict``) refused.

    Without ``columns``: all but those that begin with an underscore. ``files`` sets the number of files for small results; a large one is
    written by all tasks.
    """
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    extra = [c for c in df.columns if c not in columns]
    if strict and extra:
        raise ValueError(f"columns not asked for: {', '.join(extra)}")
    kinds = dict(df.dtypes)
    blank = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    out = df.select(*[F.coalesce(blank(c).cast("string"), F.lit("")).alias(c) if c in kinds else F.lit("").alias(c) for c in columns])
    (out.coalesce(files) if files else out).write.mode(mode).csv(path, header=True, emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode(mode).text(path)


def write_per_entity(df: DataFrame, key: str, text: str, path: str, mode: str = "overwrite") -> None:
    """A folder per entity with its lines, written where the rows are."""
    df.select(key, F.col(text).cast("string").alias("value")).repartition(key).write.mode(mode).partitionBy(key).text(path)


def preferred_order(df: DataFrame, preferred: list[str]) -> list[str]:
    """The preferred columns first, then the others in the order in which they are found, but those that begin with an underscore."""
    return [*preferred, *[c for c in df.columns if c not in preferred and not c.startswith("_")]]


def markdown_table(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> str:
    """A small result as a table; bars in cells are escaped. With ``limit`` a last line says that rows are left out."""
    columns = columns or df.columns
    shown = df.select(*columns)
    rows = shown.limit(limit + 1).collect() if limit is not None else shown.collect()
    if not rows:
        return "_No rows._"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + (["", f"_Only the first {limit} rows._"] if limit is not None and len(rows) > limit else []))


def latex_table(df: DataFrame, columns: list[str] | None = None) -> str:
    """A small result as a LaTeX table; what has a meaning there is escaped."""
    columns = columns or df.columns
    marks = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    cell = lambda v: "" if v is None else "".join(marks.get(c, c) for c in str(v))
    line = lambda r: " & ".join(cell(v) for v in r) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", r"\hline", line(columns), r"\hline", *[line(r) for r in df.select(*columns).collect()], r"\hline", r"\end{tabular}"])


def coefficient_table(results: DataFrame, digits: int = 3) -> str:
    """Models as columns and terms as rows, errors in brackets, stars at 0.10, 0.05 and 0.01."""
    rows = results.collect()  # a row per model and term
    models = list(dict.fromkeys(r["model"] for r in rows))
    terms = list(dict.fromkeys(r["term"] for r in rows))
    star = lambda p: "" if p is None else "***" if p < 0.01 else "**" if p < 0.05 else "*" if p < 0.1 else ""
    cells = {(r["term"], r["model"]): f"{r['estimate']:.{digits}f}{star(r['p_value'])} ({r['std_error']:.{digits}f})" for r in rows if r["std_error"] is not None}
    width = max([len(t) for t in terms] + [4]) + 2
    sizes = [max([len(m)] + [len(cells.get((t, m), "")) for t in terms]) + 2 for m in models]
    lines = [" " * width + "".join(m.rjust(s) for m, s in zip(models, sizes))]
    return "\n".join(lines + [t.ljust(width) + "".join(cells.get((t, m), "").rjust(s) for m, s in zip(models, sizes)) for t in terms])
