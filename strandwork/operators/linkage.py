"""Scored candidates between two tables: met by equal attributes, ranked, graded by score and gap, with evidence rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordered import top_k


@dataclass(frozen=True)
class Component:
    """A part of the score: its name, its points as a column of the joined pair, and whether it counts as strong evidence."""

    name: str
    points: Column
    strong: bool = True


def best_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, attributes: list[str], needed: list[str], limit: int) -> DataFrame:
    """(left_id, right_id): pairs among which are the ``limit`` best of each left row, for a score that grows with the attributes that are equal.

    For every set of attributes that holds one of ``needed``, a left row meets the ``limit`` right rows of equal values
    that come first by the text of their id. A right row left out has ``limit`` others before it that equal the left row at least where
    it does, so none of the best is lost, while a value that a third of all rows share brings ``limit`` pairs a row, not their
    product. Blank and null attributes equal nothing.
    """
    filled = lambda names: reduce(lambda x, y: x & y, [F.coalesce(F.col(c) != "", F.lit(False)) for c in names])
    pairs = []
    for size in range(1, len(attributes) + 1):
        for names in combinations(attributes, size):
            if not set(names) & set(needed):
                continue
            few = top_k(right.filter(filled(names)).select(right_id, *names), list(names), [F.col(right_id).cast("string")], limit)
            pairs.append(left.filter(filled(names)).select(left_id, *names).join(few, list(names)).select(left_id, right_id))
    return reduce(DataFrame.unionAll, pairs).distinct()


def score_pairs(pairs: DataFrame, components: list[Component], cap: float = 100.0) -> DataFrame:
    """``pairs`` with each component's points, ``score`` (their sum, at most ``cap``, two decimals) and ``strong``, the number of strong ones above 0."""
    scored = pairs.withColumns({f"c_{c.name}": F.coalesce(c.points.cast("double"), F.lit(0.0)) for c in components})
    total = sum((F.col(f"c_{c.name}") for c in components), F.lit(0.0))
    strong = sum(((F.col(f"c_{c.name}") > 0).cast("int") for c in components if c.strong), F.lit(0))
    return scored.withColumn("score", F.bround(F.least(total, F.lit(cap)), 2)).withColumn("strong", strong).filter("score > 0")


def rank_and_grade(scored: DataFrame, left_id: str, right_id: str, limit: int = 20, sure: tuple[float, int, float] = (70, 3, 12), fair: tuple[float, int] = (50, 2), near: tuple[float, float] = (45, 10)) -> DataFrame:
    """The best ``limit`` candidates of each left row with ``rank``, ``gap`` to the second, and a ``grade`` at rank 1.

    ``probable`` needs the score, the number of strong components and the gap of ``sure``; ``ambiguous`` the score of ``near`` with the
    second no further behind than its other number, or the score and strong components of ``fair``; the rest is
    ``unresolved``, and rows behind the first are ``candidate``. Equal scores are ordered by the text of the right id.
    """
    top = top_k(scored, [left_id], [F.col("score").desc(), F.col(right_id).cast("string")], limit)
    order = Window.partitionBy(left_id).orderBy("rank")  # at most ``limit`` rows
    second = F.coalesce(F.lead("score").over(order), F.lit(0.0))
    graded = top.withColumn("gap", F.bround(F.col("score") - second, 2)).withColumn("__second", second)
    grade = (
        F.when(F.col("rank") > 1, "candidate")
        .when((F.col("score") >= sure[0]) & (F.col("strong") >= sure[1]) & (F.col("gap") >= sure[2]), "probable")
        .when((F.col("score") >= near[0]) & (F.col("__second") >= F.col("score") - near[1]), "ambiguous")
        .when((F.col("score") >= fair[0]) & (F.col("strong") >= fair[1]), "ambiguous")
        .otherwise("unresolved")
    )
    return graded.withColumn("grade", grade).drop("__second")


def evidence_rows(scored: DataFrame, ids: list[str], components: list[Component]) -> DataFrame:
    """One row per pair and component above 0."""
    rows = F.array(*[F.struct(F.lit(c.name).alias("component"), F.col(f"c_{c.name}").alias("points"), F.lit("strong" if c.strong else "weak").alias("strength")) for c in components])
    return scored.select(*ids, F.inline(rows)).filter("points > 0")


def infer_columns(headers: list[str], roles: dict[str, tuple[str, ...]]) -> dict[str, str | None]:
    """The header that fits each role best: equal words score 3, a whole word 2, a part 1; the first of the best wins, none below 1."""
    import re

    plain = lambda h: re.sub(r"[^a-z0-9]+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", h).lower()).strip()
    found: dict[str, str | None] = {}
    for role, words in roles.items():
        best, score = None, 0
        for h in headers:
            p = plain(h)
            s = max(3 if p == w else 2 if f" {w} " in f" {p} " else 1 if w.replace(" ", "") in p.replace(" ", "") else 0 for w in words)
            if s > score:
                best, score = h, s
        found[role] = best
    return found
