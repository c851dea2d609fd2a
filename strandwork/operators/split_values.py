"""Several values packed in one cell: infer the delimiters of each source, split, keep the positions.

A first pass, over the counts of alike cells, scores every candidate delimiter of every source on two grounds. Type regularity:
the share of its pieces that begin like a value of the source's type, or, where values are plain text, that have the
shape of a whole cell without it. Count consistency: how little the number of its pieces, against the number of values,
spreads over the source's cells. Marks that merely occur within values score low; the widest gap between the scores
separates them from delimiters. Its result has one row per source and candidate, whatever the number of cells. The second
pass splits at runs of accepted delimiters; where values of the type have a beginning of their own it splits only before one, so that
a delimiter which also occurs within values (``;`` in an address, ``,`` in an identifier) doesn't cut them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.session import cut

# Candidate delimiters (name, pattern) and value types (name, what a value begins with, its mark in a skeleton), most specific first.
DELIMITERS = {
    "line break": r"[\r\n]+", "tab": r"\t+", "semicolon": r"\s*;\s*", "comma": r"\s*,\s*", "bar": r"\s*\|\s*", "slash": r"\s+/\s+", "ampersand": r"\s*&\s*",
    "plus": r"\s*\+\s*", "and": r"\s+and\s+", "fullwidth": r"\s*[；，、]\s*", "space": r"[  ]+",
    "dot": r"\s*\.\s*", "colon": r"\s*:\s*", "hyphen": r"\s*-\s*", "underscore": r"_+", "equals": r"\s*=\s*", "question": r"\s*\?\s*",
}
TYPES = (
    ("address", r"(?:https?|ftp)://", "\x01"),
    ("doi", r"(?:https?://(?:dx\.)?doi\.org/|(?i:doi:)\s*)?10\.\d{4,9}/", "\x02"),
    ("number", r"\d", "\x03"),
    ("text", r"[^\s]", r"[^\s]"),
)
#: single characters that delimiters are made of
_CHARS = {"semicolon": ";", "comma": ",", "bar": "|", "ampersand": "&", "plus": "+", "fullwidth": "；，、", "dot": ".", "colon": ":", "hyphen": r"\-", "underscore": "_", "equals": "=", "question": "?"}
_QUOTES = "\"'“”‘’`"
_OPEN = rf"[\s{_QUOTES}\[(]*"


@dataclass(frozen=True)
class SplitRule:
    """What was inferred of one source."""

    source: str
    kind: str
    delimiters: tuple[str, ...]
    scores: tuple[tuple[str, float], ...]


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _above_gap(scores: dict[str, float], floor: float = 0.01) -> set[str]:
    """The candidates above the widest gap, as a ratio, between neighbouring scores; what scores no more than ``floor`` is below any."""
    order = sorted(((max(v, floor), k) for k, v in scores.items()), reverse=True)
    levels = [v for v, _ in order] + [floor]
    widest = max(range(len(order)), key=lambda i: levels[i] / levels[i + 1], default=None)
    return {k for v, k in order if v > floor and v >= levels[widest]}


def infer_rules(cells: DataFrame, source: str, cell: str, min_type_share: float = 0.6, min_shape_share: float = 0.05) -> dict[str, SplitRule]:
    """One rule per value of ``source``: the most specific type that ``min_type_share`` of its cells begin with, and
    the delimiters whose score, regularity times consistency over the cells that hold them, is above the widest gap.

    For plain text a piece is regular if ``min_shape_share`` of the source's cells are wholly of its shape and hold no such delimiter.
    Null and blank cells and null sources don't count; an empty table gives no rule. The collected result has a row per source, so ``source``
    must be a set of bounded size, such as names of columns.
    """
    text = F.col(cell)
    filled = cells.filter(F.col(source).isNotNull() & (F.length(F.trim(text)) > 0))
    # the cells are read once: all that the scores depend on is a cell's skeleton, and alike ones are counted
    profile = cut(filled.groupBy(F.col(source).alias("source"), _skeleton(text).alias("s")).agg(F.count("*").alias("n")))
    share = lambda flag: F.sum(F.col("n") * flag.cast("int")) / F.sum("n")
    begins = [share(F.col("s").rlike(rf"^[\s;,|]*{_OPEN}{mark}")).alias(f"t{t}") for t, (_, _, mark) in enumerate(TYPES)]
    kinds = {r["source"]: next((x for i, x in enumerate(TYPES) if r[f"t{i}"] >= min_type_share), TYPES[-1]) for r in profile.groupBy("source").agg(*begins).collect()}
    rules = {}
    for kind, _, mark in dict.fromkeys(kinds.values()):
        own = profile.filter(F.col("source").isin(*[k for k, v in kinds.items() if v[0] == kind]))
        if kind == TYPES[-1][0]:
            found = _text_scores(own, min_shape_share)
        else:
            found = _typed_scores(own.withColumn("starts", _count(F.col("s"), rf"(?:^|[\s;,|/&+；，、{_QUOTES}\[]){mark}")), mark)
        for name in (k for k, v in kinds.items() if v[0] == kind):
            scores = found.get(name, {})
            allowed = _above_gap(scores)
            if kind == TYPES[-1][0]:  # nothing else guards a cut between words, so most pieces must be regular
                allowed = {k for k in allowed if scores[k] > 0.5}
            rules[name] = SplitRule(name, kind, tuple(k for k in DELIMITERS if k in allowed), tuple((k, round(v, 4)) for k, v in scores.items()))
    return rules


def _typed_scores(own: DataFrame, mark: str) -> dict[str, dict[str, float]]:
    """Scores of each source's delimiters by the beginnings of values; ``own`` has source, s, n and starts, the number of values."""
    scores = []
    for name, pattern in DELIMITERS.items():
        pieces, good = _count(F.col("s"), pattern), _count(F.col("s"), rf"{pattern}(?={_OPEN}{mark})")
        held, n = F.col("s").rlike(pattern), F.col("n")
        regular = F.try_divide(F.sum(F.when(held, n * good / pieces)), F.sum(F.when(held, n)))
        q = (good + 1) / F.greatest("starts", good + 1)
        mean = F.try_divide(F.sum(F.when(held, n * q)), F.sum(F.when(held, n)))
        square = F.try_divide(F.sum(F.when(held, n * q * q)), F.sum(F.when(held, n)))
        spread = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
        scores.append((regular * (1 - spread)).alias(name))
    return {r["source"]: {k: r[k] for k in DELIMITERS if r[k] is not None} for r in own.groupBy("source").agg(*scores).collect()}


def _text_scores(own: DataFrame, min_shape_share: float) -> dict[str, dict[str, float]]:
    """Scores of each source's delimiters by shapes: pieces of a delimiter look like whole cells that hold none, and a cell's pieces look alike."""
    shape = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\band\b", "a"), r"[a\x01-\x03]+(?: [a\x01-\x03]+)*", "a"), rf"[{_QUOTES}]", ""))
    total = own.groupBy("source").agg(F.sum("n").alias("all"))
    per = own.select("source", "s", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(p).alias("p")) for k, p in DELIMITERS.items()])))
    per = per.withColumn("held", F.expr("s rlike p"))
    whole = per.filter("not held").groupBy("source", "d", shape(F.col("s")).alias("shape")).agg(F.sum("n").alias("m")).join(total, "source").filter(F.col("m") >= min_shape_share * F.col("all")).select("source", "d", "shape", F.lit(1.0).alias("seen"))
    # the pattern of a row is one of the fixed ones, so each is split by its own literal
    parts = F.coalesce(*[F.when(F.col("d") == k, F.split("s", p, -1)) for k, p in DELIMITERS.items()])
    pieces = per.filter("held").select("source", "d", "s", "n", F.explode(F.filter(parts, lambda x: F.trim(x) != "")).alias("piece")).select("source", "d", "s", "n", shape(F.col("piece")).alias("shape"))
    # where every cell holds the delimiter nothing is known of whole cells: the likeness of a cell's pieces tells, if no other delimiter is sure
    known = whole.select("source", "d", F.lit(0.0).alias("unseen")).distinct()
    judged = pieces.join(whole, ["source", "d", "shape"], "left").join(known, ["source", "d"], "left")
    alike = judged.groupBy("source", "d", "s", "n").agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("sure"), F.avg(F.coalesce("seen", "unseen", F.lit(1.0))).alias("maybe"), F.count_distinct("shape").alias("shapes"))
    mean = lambda c: F.sum(F.col("n") * F.col(c) / F.col("shapes")) / F.sum("n")
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for r in alike.groupBy("source", "d").agg(mean("sure").alias("sure"), mean("maybe").alias("maybe")).collect():
        out.setdefault(r["source"], {})[r["d"]] = (r["sure"], r["maybe"])
    pick = {source: 0 if any(sure > 0.5 for sure, _ in v.values()) else 1 for source, v in out.items()}
    return {source: {d: v[d][pick[source]] for d in DELIMITERS if d in v} for source, v in out.items()}


def _skeleton(text: Column) -> Column:
    """Delimiters, quotes and white space of a cell as they are, beginnings of addresses and identifiers and numbers as marks, other runs as one ``a``."""
    s = F.regexp_replace(text, r"[\x01-\x04]", "")
    s = F.regexp_replace(s, TYPES[1][1], TYPES[1][2])
    s = F.regexp_replace(s, TYPES[0][1], TYPES[0][2])
    s = F.regexp_replace(s, r"\d+(?:\.\d+)?", TYPES[2][2])
    s = F.regexp_replace(s, r"(?<=\s)and(?=\s)", "\x04")
    s = F.regexp_replace(s, rf"[^\s;,|/&+；，、.:=?_\-{_QUOTES}\[\]\x01-\x04]+", "a")
    s = F.regexp_replace(F.regexp_replace(s, "\x04", "and"), r"[\r\n]+", "\n")
    return F.regexp_replace(F.regexp_replace(s, r"\t+", "\t"), r"[ \u00a0]+", " ")


def _pieces(cell: Column, rule: SplitRule) -> Column:
    start = next(begin for n, begin, _ in TYPES if n == rule.kind)
    bare = F.regexp_replace(cell, r"(?U)^\s+|(?<!\s)\s+$", "")
    bare = F.when(bare.rlike(r"^\[[\s\S]*\]$"), F.regexp_extract(bare, r"^\[([\s\S]*)\]$", 1)).otherwise(bare)
    if rule.delimiters:
        # possessive, so that a long run takes no stack; tried only where a run begins, so that it takes no time either
        run = rf"(?:[{_QUOTES}]*(?:{'|'.join(DELIMITERS[d] for d in rule.delimiters)}))++"
        inside = "".join(_CHARS.get(d, "") for d in rule.delimiters)
        fresh = rf"(?<![\s{inside}{_QUOTES}]){run}"
        bare = F.regexp_replace(bare, rf"^{run}|{fresh}$", "")
        parts = F.split(bare, rf"{fresh}(?={_OPEN}{start})", -1)
    else:
        parts = F.array(bare)
    parts = F.transform(parts, lambda x: F.regexp_replace(x, rf"(?U)^[\s{_QUOTES}]+|(?<![\s{_QUOTES}])[\s{_QUOTES}]+$", ""))
    return F.filter(parts, lambda x: x != "")


def split_values(cells: DataFrame, source: str, cell: str, rules: dict[str, SplitRule] | None = None, pos: str = "pos", item: str = "item_value", at_least: int = 1) -> DataFrame:
    """One row per value: the columns of ``cells`` but ``cell``, then ``pos`` (from 1) and ``item`` (as written, without
    outer blanks, quotes and list marks). Cells with fewer than ``at_least`` values give none; repeats count and stay.

    Null and blank cells hold no value. Sources without rule (null, or seen first after the rules were made) are left whole. Columns
    of the cells that are called ``pos`` or ``item`` give way to the new ones; repeated cells stay repeated, and an
    empty table gives an empty result. The split is a narrow step: the only shuffle is the profile's, of one row per source
    and task.
    """
    cells = cells.drop(*[c for c in (pos, item) if c not in (source, cell)])
    if rules is None:
        rules = infer_rules(cells, source, cell)
    text = F.col(cell)
    whole = F.array(F.regexp_replace(text, r"(?U)^\s+|(?<!\s)\s+$", ""))
    cases = [(F.col(source) == F.lit(name), _pieces(text, rule)) for name, rule in rules.items() if name is not None]
    parts = reduce(lambda acc, case: acc.when(*case), cases[1:], F.when(*cases[0])).otherwise(whole) if cases else whole
    keep = [c for c in cells.columns if c != cell]
    return (
        cells.filter(F.length(F.trim(text)) > 0)
        .withColumn("__parts", parts)
        .filter(F.size("__parts") >= at_least)
        .select(*[F.col(f"`{c}`") for c in keep], F.posexplode("__parts").alias("__p", item))
        .select(*[F.col(f"`{c}`") for c in keep], (F.col("__p") + 1).alias(pos), item)
    )
