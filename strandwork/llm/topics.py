"""Problem 5: repository rows matched to applications without a shared key, by BM25 retrieval over subject and people.

An application is a document of terms: the phrases of its title and its lead (an entity of the name linkage). A repository row asks
once for each of its people, with the phrases of its paper's title read as the application's by links learnt from the data
(``synonyms``). Titles are equally short, so the BM25 score of a pair is the sum of the inverse document frequencies of
the terms it shares. Postings are kept per person and pair of phrases, so a frequent term alone never brings its list
together with an asking row; what shares fewer terms scores less and is needed only as a number, for the gap.
A pair counts if each is the other's nearest and a logistic function of the gap to the runner-up makes it likelier true than not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.names import link_names, typed_names
from strandwork.llm.phrases import title_keys, title_phrases
from strandwork.llm.synonyms import learn_links
from strandwork.session import cut
from strandwork.sources.tables import table


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """(intercept, slopes) of a ridge logistic regression by Newton steps; raises if they don't settle."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            return beta
    if len(x):
        raise RuntimeError(f"the calibration doesn't settle in {rounds} steps")
    return beta


def _twos(names: Column) -> Column:
    """All pairs (a, b), a before b, of a sorted array."""
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


class Index:
    """Postings of the documents (id, person, names: the sorted array of its phrases) and their weights."""

    def __init__(self, documents: DataFrame):
        self.documents = cut(documents)
        total = float(self.documents.select("id").distinct().count())
        idf = lambda n: F.log(1 + (F.lit(total) - n + 0.5) / (n + 0.5))
        count = lambda df, *keys: df.distinct().groupBy(*keys).agg(F.count("*").alias("n"))
        phrases = self.documents.select("id", F.explode("names").alias("d"))
        self.phrase_weight = count(phrases, "d").select("d", idf(F.col("n")).alias("w"))
        people = count(self.documents.select("id", "person"), "person")
        self.person_weight = people.select("person", idf(F.col("n")).alias("pw"))
        self.postings = self.documents.select("id", "person", F.inline(_twos(F.col("names"))))
        alone = count(self.documents.select("id", "person", F.explode("names").alias("d")), "person", "d").select(F.concat_ws("|", F.lit("pd"), F.col("person").cast("string"), "d").alias("at"), "n")
        subjects = count(self.postings.select("id", "a", "b"), "a", "b").select(F.concat_ws("|", F.lit("dd"), "a", "b").alias("at"), "n")
        self.sizes = cut(alone.unionByName(subjects).unionByName(people.select(F.concat(F.lit("p|"), F.col("person").cast("string")).alias("at"), "n")))

    def weighed(self, asks: DataFrame) -> DataFrame:
        """Asks (id, person, names) with their weights and the score of a document that shares every term."""
        # sets of phrases recur: each is weighed once
        sets = asks.select("names").distinct()
        terms = sets.select("names", F.explode("names").alias("d")).join(self.phrase_weight, "d").groupBy("names").agg(F.sort_array(F.collect_set(F.struct("d", "w"))).alias("terms"))
        got = asks.join(terms, "names").select("id", "person", "terms").join(self.person_weight, "person")
        return got.withColumn("whole", F.aggregate("terms", F.col("pw"), lambda s, t: s + t["w"]))

    def pairs(self, asks: DataFrame) -> DataFrame:
        """(id, person, document, score) of all documents that share the person and two phrases at least."""
        names = lambda: F.transform("terms", lambda t: t["d"])
        asked = asks.select("id", "person", "terms", "pw", F.inline(_twos(names())))
        held = self.postings.join(self.documents.withColumnRenamed("names", "all"), ["id", "person"]).withColumnRenamed("id", "document")
        met = asked.join(held, ["person", "a", "b"]).withColumn("shared", F.filter("terms", lambda t: F.array_contains("all", t["d"])))
        # a pair that shares more phrases comes once for each two of them: the first two stand for it
        once = met.filter((F.col("a") == F.col("shared")[0]["d"]) & (F.col("b") == F.col("shared")[1]["d"]))
        return once.select("id", "person", "document", F.aggregate("shared", F.col("pw"), lambda s, t: s + t["w"]).alias("score")).groupBy("id", "person", "document").agg(F.max("score").alias("score"))

    def gaps(self, asks: DataFrame, pairs: DataFrame) -> DataFrame:
        """(id, person, best, share, gap): the highest score of an ask and how far the next class of documents is behind, both also as shares of the whole."""
        names = F.transform("terms", lambda t: t["d"])
        who = F.col("person").cast("string")
        sets = F.concat(
            F.array(F.struct(F.concat(F.lit("p|"), who).alias("at"), F.col("pw").alias("score"))),
            F.transform("terms", lambda t: F.struct(F.concat_ws("|", F.lit("pd"), who, t["d"]).alias("at"), (F.col("pw") + t["w"]).alias("score"))),
            F.flatten(F.transform("terms", lambda t, i: F.transform(F.slice("terms", i + 2, F.size(names)), lambda u: F.struct(F.concat_ws("|", F.lit("dd"), t["d"], u["d"]).alias("at"), (t["w"] + u["w"]).alias("score"))))),
        )
        top = pairs.groupBy("id", "person").agg(F.max("score").alias("top"))
        ranked = pairs.join(top, ["id", "person"]).groupBy("id", "person").agg(F.max("top").alias("top"), F.count_if(F.col("score") >= F.col("top") - 1e-9).alias("tied"), F.max(F.when(F.col("score") < F.col("top") - 1e-9, F.col("score"))).alias("second"))
        found = asks.select("id", "person", "whole", F.inline(sets)).join(self.sizes, "at").groupBy("id", "person").agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("score", "n")), asc=False).alias("sets"))
        got = found.join(ranked, ["id", "person"], "left")
        first = F.coalesce("top", F.col("sets")[0]["score"])
        # a set of terms holds a further document if it is larger than the class of the best ones
        beyond = F.array_max(F.transform(F.filter("sets", lambda s: s["n"] > F.col("tied")), lambda s: s["score"]))
        after = F.when(F.col("top").isNull(), F.coalesce(F.try_element_at("sets", F.lit(2))["score"], F.lit(0.0))).otherwise(F.coalesce(F.greatest("second", beyond), F.lit(0.0)))
        return got.select("id", "person", first.alias("best"), (first / F.col("whole")).alias("share"), (F.greatest(F.lit(0.0), first - after) / F.col("whole")).alias("gap"))


def match_subject_and_people(queries: DataFrame, documents: DataFrame, calibration_rows: int = 20_000, slack: float = 0.2, least_confidence: float = 0.5) -> DataFrame:
    """(query, document, score, gap, confidence) of the pairs that are mutually nearest and likelier true than not.

    ``queries`` and ``documents`` have id, person and names (sorted array of phrases), a row per person. A pair is nearest on a side if its
    score is within ``slack`` of that side's highest. The confidence, a function of the gap and of the share of its whole score that an ask attains, is calibrated on at most about ``calibration_rows`` asking
    rows drawn by a hash, against decoys: the same rows with another
    person, all people alike often. Where p is the logistic
    probability that the row is no decoy, (1 - p) / p of such rows match by chance. Everything else covers all rows. Nulls match
    nothing, ties all count, repeated rows count once and empty tables give an empty result.
    """
    clean = lambda df: df.select("id", "person", "names").dropna().distinct()
    index = Index(clean(documents))
    asks = cut(index.weighed(clean(queries)))
    pairs = cut(index.pairs(asks))
    # only an ask with a pair can be matched
    gaps = index.gaps(asks.join(pairs.select("id", "person").distinct(), ["id", "person"], "left_semi"), pairs)
    share = max(1, math.ceil(asks.count() / calibration_rows))
    picked = cut(asks.filter(F.pmod(F.xxhash64("id", "person"), F.lit(share)) == 0))
    rows = sorted(picked.select("id", "person").collect())  # bounded by calibration_rows
    people = sorted({r["person"] for r in rows})  # each alike often, so that one who is named everywhere doesn't set what chance can do
    turned = [(r["id"], r["person"], people[(k + len(people) // 2) % len(people)]) for k, r in enumerate(rows)]
    swap = queries.sparkSession.createDataFrame([t for t in turned if t[1] != t[2]], "id bigint, person bigint, other bigint")
    names = F.transform("terms", lambda t: t["d"]).alias("names")
    decoys = cut(index.weighed(picked.join(swap, ["id", "person"]).select("id", F.col("other").alias("person"), names).distinct()))
    seen = lambda df: [(r["gap"], r["share"]) for r in df.select("gap", "share").collect()]
    false, real = seen(index.gaps(decoys, index.pairs(decoys))), seen(index.gaps(picked, pairs.join(picked.select("id", "person"), ["id", "person"], "left_semi")))
    start, by_gap, by_share = map(float, fit_logistic(np.array(real + false, float).reshape(-1, 2), np.array([1.0] * len(real) + [0.0] * len(false))))
    odds = F.exp(-(start + by_gap * F.col("gap") + by_share * F.col("share"))) * (len(real) / max(1, len(false)))
    sure = gaps.select("id", "person", "best", "gap", F.greatest(F.lit(0.0), 1 - odds).alias("confidence")).filter(F.col("confidence") >= least_confidence)
    nearest = pairs.groupBy("document", "person").agg(F.max("score").alias("back"))
    mutual = pairs.join(sure, ["id", "person"]).join(nearest, ["document", "person"]).filter((F.col("score") >= (1 - slack) * F.col("best")) & (F.col("score") >= (1 - slack) * F.col("back")))
    return mutual.groupBy(F.col("id").alias("query"), "document").agg(F.max("score").alias("score"), F.max("gap").alias("gap"), F.max("confidence").alias("confidence"))


def subjects(who: DataFrame, keys: DataFrame, lead: DataFrame, titles: DataFrame, **learning: float) -> tuple[DataFrame, DataFrame]:
    """Queries and documents (id, person, names) of people (id, person) and title keys (id, key) of both sides.

    Phrases are counted and links learnt over all rows; phrases without a link are no terms.
    """
    phrases = cut(title_phrases(keys.select("key").unionByName(titles.select("key"))))
    asked = who.join(keys, "id").select("person", "key").distinct().join(phrases, "key")
    held = lead.join(titles, "id").select("person", "key").distinct().join(phrases, "key")
    links = learn_links(asked, held, **learning)
    read = phrases.join(links.select(F.col("c").alias("phrase"), "d"), "phrase").groupBy("key").agg(F.sort_array(F.collect_set("d")).alias("names"))
    kept = phrases.join(links.select(F.col("d").alias("phrase")).distinct(), "phrase").groupBy("key").agg(F.sort_array(F.collect_set("phrase")).alias("names"))
    return who.join(keys.join(read, "key"), "id").select("id", "person", "names"), lead.join(titles.join(kept, "key"), "id").select("id", "person", "names")


def subject_queries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Repository rows and applications as (id, person, names), people as entities of the name linkage."""
    people = cut(link_names(typed_names(spark, folder).filter("kind = 'person'")).select(F.col("name").alias("typed"), F.col("entity").alias("person")))
    clean = lambda c: F.regexp_replace(c, r"(?U)^\s+|(?<!\s)\s+$", "")
    repos, apps = table(spark, folder, "ukb_dmca_repositories"), table(spark, folder, "application_level_leakage")
    lead = cut(apps.select(F.col("application_id").alias("id"), clean("application_pi").alias("typed")).join(people, "typed").select("id", "person").distinct())
    named = F.array_compact(F.concat(F.coalesce(F.split("paper_authors", r"[;|]"), F.array().cast("array<string>")), F.array("repo_owner_public_name")))
    who = repos.filter("paper_title is not null").select(F.col("repo_row_id").alias("id"), F.explode(F.array_distinct(F.transform(named, clean))).alias("typed"))
    # only a lead can be matched: other people have no posting
    leads = people.join(lead.select("person").distinct(), "person", "left_semi")
    who = cut(who.join(leads, "typed").select("id", "person").distinct())
    return subjects(who, cut(title_keys(repos, "repo_row_id", "paper_title")), lead, cut(title_keys(apps, "application_id", "application_title")))


def p5_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The matches with score, gap to the next best and confidence."""
    matches = match_subject_and_people(*subject_queries(spark, folder))
    return matches.select(F.col("query").alias("repo_row_id"), F.col("document").alias("application_id"), "score", "gap", "confidence")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_matches(spark, folder).select("repo_row_id", "application_id")


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches}
ORACLE_SQL: dict[str, str] = {}
