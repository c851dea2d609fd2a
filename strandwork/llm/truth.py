"""Problem 1: one surviving value per field of each group of duplicate records, by iterative truth discovery.

A source has one claim per group and field: its latest usable value. Two estimates alternate: the support of each claimed value,
the sum of the weights of the sources that claim it, and the weight of each source, the log odds of its share of claims
that agree with the value of highest support. The claims of a group are one short row, so a round is a pass without
shuffle; weights are one number per source.

Where the order of the sources is known (a trust rank), it enters as a prior: each ranked source weighs more than all
below it together, however they agree, and what the agreement says comes on top.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.addresses import repository, sql_repository
from strandwork.operators.timestamps import normalise_timestamps
from strandwork.session import cut
from strandwork.sources.tables import table

FIELDS = ("source_repo", "first_observed_repo_date", "first_observed_offending_commit_date", "removal_or_disable_date")
_DAY = 86_400_000_000
_PLAIN_DAY = r"^\s*(\d{4})[-/](\d{2})[-/](\d{2})(?:[T ]\d{2}:\d{2}:\d{2}(?:Z|\+00:00)?)?\s*$"


def source_weights(agreement: dict[str, float], ranks: dict[str, int] | None = None, least: float = 0.05, margin: float = 1e-3) -> dict[str, float]:
    """Log odds of each source's agreement, ``least`` or more; with ``ranks`` raised so that each ranked source exceeds the sum of all below.

    Sources without rank are below the ranked ones. Sources of one rank don't outweigh each other.
    """
    odds = {s: max(least, math.log(min(0.99, max(0.01, p)) / (1 - min(0.99, max(0.01, p))))) for s, p in agreement.items()}
    if ranks is None:
        return odds
    below = sum(w for s, w in odds.items() if s not in ranks)
    for rank in sorted({ranks[s] for s in odds if s in ranks}, reverse=True):
        level = [s for s in odds if ranks.get(s) == rank]
        odds |= {s: max(odds[s], below + margin) for s in level}
        below += sum(odds[s] for s in level)
    return odds


def _winner(weights: dict[str, float], ranked: bool) -> Column:
    """The claim whose value has the highest support; among its claims the best source's, then the latest, then the smallest record."""
    known = F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))])
    weight = lambda c: known[c["source"]]
    support = lambda c: F.round(F.aggregate("claims", F.lit(0.0), lambda s, d: s + F.when(d["value"] == c["value"], weight(d)).otherwise(0.0)), 9)
    own = weight if ranked else (lambda c: F.lit(0.0))
    return F.array_max(F.transform("claims", lambda c: F.struct(support(c).alias("support"), own(c).alias("own"), c["recency"].alias("recency"), c["neg"].alias("neg"), c["value"].alias("value"))))


def discover_truth(
    claims: DataFrame, ranks: dict[str, int] | None = None, max_rounds: int = 100, tolerance: float = 1e-6, prior: float = 0.8, prior_weight: float = 10.0
) -> tuple[DataFrame, dict[str, float], int]:
    """The surviving claim per (entity, field), the weight of each source, and the rounds it took.

    ``claims`` has entity, field and claims, an array of (source, recency, neg, value) with one entry per source, as
    ``gathered`` makes it. The winner is the value of highest support; ties go to the better source (with ``ranks``), the
    later and then the smaller record. The shares of agreement start at ``prior`` and count ``prior_weight`` claims of it. Raises if the
    weights don't settle in ``max_rounds``. An empty table gives an empty result.
    """
    claims = cut(claims)
    sources = sorted(r[0] for r in claims.select(F.explode("claims.source")).distinct().collect())  # a bounded set
    agreement = dict.fromkeys(sources, prior)
    weights = source_weights(agreement, ranks)
    for rounds in range(1, max_rounds + 1):
        judged = claims.select("claims", (_winner(weights, ranks is not None) if weights else F.lit(None).cast("struct<value:string>")).alias("w")).select(F.explode("claims").alias("c"), F.col("w.value").alias("won"))
        counts = judged.groupBy("c.source").agg(F.count_if(F.col("c.value") == F.col("won")).alias("agree"), F.count("*").alias("all")).collect()
        agreement = {r["source"]: (r["agree"] + prior * prior_weight) / (r["all"] + prior_weight) for r in counts}
        before, weights = weights, source_weights(agreement, ranks)
        if max((abs(weights[s] - before[s]) for s in weights), default=0) <= tolerance:
            break
    else:
        raise RuntimeError(f"the weights still change after {max_rounds} rounds")
    if not weights:
        return claims.select("entity", "field", F.lit("").alias("value"), F.lit(0).cast("bigint").alias("record"), F.lit(0.0).alias("support")), {}, rounds
    won = claims.select("entity", "field", _winner(weights, ranks is not None).alias("w"))
    return won.select("entity", "field", F.col("w.value").alias("value"), (-F.col("w.neg")).alias("record"), F.col("w.support").alias("support")), weights, rounds


def gathered(records: DataFrame, fields: tuple[str, ...], least_records: int = 1) -> DataFrame:
    """(entity, field, claims) of ``records`` (entity, source, recency, record and a column per field, null where it is unusable).

    A source's claim is its latest record with a value, then the smallest. Entities with fewer than ``least_records``
    records, usable or not, and fields without a claim give no row; null entities are left out, null sources claim
    nothing but their records count. Records fold to one row per entity and source before the shuffle, so a group that holds a third of
    all rows is one row per task and source there.
    """
    claim = lambda f: F.max(F.when(F.col(f).isNotNull() & F.col("source").isNotNull(), F.struct("recency", (-F.col("record")).alias("neg"), F.col(f).cast("string").alias("value")))).alias(f)
    folded = records.filter("entity is not null").groupBy("entity", "source").agg(F.count("*").alias("n"), *[claim(f) for f in fields])
    groups = folded.groupBy("entity").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", *fields)).alias("by")).filter(F.col("n") >= least_records)
    claims = lambda f: F.transform(F.filter("by", lambda x: x[f].isNotNull()), lambda x: F.struct(x["source"].alias("source"), x[f]["recency"].alias("recency"), x[f]["neg"].alias("neg"), x[f]["value"].alias("value")))
    return groups.select("entity", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), claims(f).alias("claims")) for f in fields]))).filter(F.size("claims") > 0)


def lineage_records(lineages: DataFrame) -> DataFrame:
    """Records of ukb_dmca_lineages with a column per field, null where the value is unusable.

    A date is usable if it names a real calendar day from 2008 to 2026 (compared as days); a repository if both owner
    and name are there. Days in the plain form are read at once; only others go through the cascade of forms.
    """
    entity = F.upper(F.regexp_replace("lineage_id", r"(?U)^\s+|(?<!\s)\s+$", ""))
    dates = FIELDS[1:]
    plain = lambda f: F.try_to_date(F.concat_ws("-", *[F.regexp_extract(f, _PLAIN_DAY, g) for g in (1, 2, 3)]))
    is_plain = lambda f: F.coalesce(F.col(f).rlike(_PLAIN_DAY), F.lit(False))
    out = lineages.select(
        entity.alias("entity"), F.lower(F.trim("record_source")).alias("source"), F.col("fetched_at_utc").alias("recency"), F.col("record_id").alias("record"), repository(F.col("source_repo")).alias("source_repo"),
        *[F.when(is_plain(f), plain(f)).alias(f"{f}_day") for f in dates], *[F.when(~is_plain(f), F.col(f)).alias(f) for f in dates],
    ).filter("entity is not null and entity != ''")
    for f in dates:
        out = normalise_timestamps(out, f, out=f"{f}_us")
    day = lambda f: F.coalesce(f"{f}_day", F.date_from_unix_date(F.floor(F.col(f"{f}_us") / _DAY).cast("int")))
    return out.select("entity", "source", "recency", "record", "source_repo", *[F.when(F.year(day(f)).between(2008, 2026), day(f).cast("string")).alias(f) for f in dates])


def trust_ranks(spark: SparkSession, folder: str) -> dict[str, int]:
    """The fixed table of record sources (six rows)."""
    return {r["record_source"].strip().lower(): r["trust_rank"] for r in table(spark, folder, "lineage_record_sources").collect()}


def _lineage_claims(spark: SparkSession, folder: str) -> DataFrame:
    return gathered(lineage_records(table(spark, folder, "ukb_dmca_lineages")), FIELDS, least_records=2)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    winners, _, _ = discover_truth(_lineage_claims(spark, folder), trust_ranks(spark, folder))
    return winners.select(F.col("entity").alias("lineage_id"), F.col("field").alias("field_name"), F.col("record").alias("record_id"))


def p1_voted(spark: SparkSession, folder: str) -> DataFrame:
    """The value of highest support where no trust order is given: sources are weighed by their agreement alone."""
    winners, _, _ = discover_truth(_lineage_claims(spark, folder))
    return winners.select(F.col("entity").alias("lineage_id"), F.col("field").alias("field_name"), "value", "record", "support")


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The weight of each source with and without the trust order, and the rounds both took."""
    claims = cut(_lineage_claims(spark, folder))
    (_, ranked, n), (_, free, m) = discover_truth(claims, trust_ranks(spark, folder)), discover_truth(claims)
    return spark.createDataFrame([(s, ranked[s], free[s], n, m) for s in ranked], "record_source string, ranked_weight double, free_weight double, ranked_rounds int, free_rounds int")


def p1_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The merged record of each lineage, as a row with one column per field."""
    winners, _, _ = discover_truth(_lineage_claims(spark, folder), trust_ranks(spark, folder))
    pick = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    return winners.groupBy(F.col("entity").alias("lineage_id")).agg(*pick)


QUERIES = {"p1_found": p1_found, "p1_voted": p1_voted, "p1_survivors": p1_survivors, "p1_sources": p1_sources}

_FORMS = "['%Y-%m-%d', '%Y/%m/%d', '%d %b %Y', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S+00:00']"
_CLAIMS = " UNION ALL ".join(
    f"SELECT upper(trim(lineage_id)) AS lineage_id, '{f}' AS field_name, record_id, record_source, fetched_at_utc, "
    + (sql_repository(f) if f == "source_repo" else f"CASE WHEN year(try_strptime(trim({f}), {_FORMS})) BETWEEN 2008 AND 2026 THEN strftime(try_strptime(trim({f}), {_FORMS}), '%Y-%m-%d') END")
    + " AS value FROM ukb_dmca_lineages"
    for f in FIELDS
)
_RANKED = f"""
WITH claims AS ({_CLAIMS}),
many AS (SELECT upper(trim(lineage_id)) AS lineage_id FROM ukb_dmca_lineages GROUP BY ALL HAVING count(*) >= 2),
ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY lineage_id, field_name ORDER BY trust_rank, fetched_at_utc DESC, record_id) AS n
  FROM claims c JOIN many USING (lineage_id) LEFT JOIN lineage_record_sources USING (record_source) WHERE value IS NOT NULL
)"""
ORACLE_SQL = {
    "p1_found": f"{_RANKED} SELECT lineage_id, field_name, record_id FROM ranked WHERE n = 1",
    "p1_survivors": f"{_RANKED} SELECT lineage_id, " + ", ".join(f"max(CASE WHEN field_name = '{f}' THEN value END) AS {f}" for f in FIELDS) + " FROM ranked WHERE n = 1 GROUP BY lineage_id",
}
