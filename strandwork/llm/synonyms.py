"""Which phrases of one side mean which phrases of the other, learnt from people that both sides name.

If a paper stems from an application, both treat one subject in whatever words. Most pairs of a lead's papers and
applications don't belong together, so a pair of phrases is judged only within pairs of titles that share another linked phrase
already: there, phrases of one meaning meet far more often than independence has it. Phrases that titles have in
common because one was copied from the other (methods, populations) are told apart by judging equal phrases only where
the other link is between different words. Each round's links are the next one's evidence; a person counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.session import cut


def _pairs(content: DataFrame, left: str, right: str) -> DataFrame:
    """(person, left, right): different phrases of one title of a person."""
    sets = content.groupBy("person", "key").agg(F.collect_set("phrase").alias("s"))
    return sets.select("person", F.col("s"), F.explode("s").alias(left)).select("person", left, F.explode("s").alias(right)).filter(F.col(left) != F.col(right)).distinct()


def _other_words(c: Column, d: Column) -> Column:
    """Whether two phrases are worded differently, more than by slips of the pen or words left out: such a link can't come from a copied title."""
    left, right = F.split(c, " "), F.split(d, " ")
    return (F.size(F.array_except(left, right)) > 0) & (F.size(F.array_except(right, left)) > 0) & (F.levenshtein(c, d) > F.greatest(F.lit(2), 0.2 * F.greatest(F.length(c), F.length(d))))


def learn_links(asked: DataFrame, held: DataFrame, rounds: int = 4, least_people: int = 3, first_lift: float = 3.0, lift: float = 10.0, evidence: float = 12.0) -> DataFrame:
    """(c, d, lift): phrase ``c`` of the asking side means phrase ``d`` of the other, at most one ``d`` per ``c``.

    ``asked`` and ``held`` have person, key and phrase. A link needs ``least_people`` people, ``lift`` times the number that independence
    expects, and a log-likelihood ratio of ``evidence``. Nothing but distinct (person, phrase, phrase) rows is shuffled, whose number per
    person is bounded by the vocabulary, however many titles one has. Empty tables give no link.
    """
    both = asked.select("person").distinct().join(held.select("person").distinct(), "person")
    papers = cut(_pairs(asked.join(both, "person", "left_semi"), "c1", "c"))
    grants = cut(_pairs(held.join(both, "person", "left_semi"), "d1", "d"))
    links = cut(papers.select(F.col("c1").alias("c")).distinct().join(grants.select(F.col("d1").alias("c")).distinct(), "c").select("c", F.col("c").alias("d"), F.lit(1.0).alias("lift")))
    for n in range(rounds):
        known = links.select(F.col("c").alias("c1"), F.col("d").alias("d1"), _other_words(F.col("c"), F.col("d")).cast("int").alias("other"))
        own = links.select("c", F.col("d").alias("own"))
        seen = papers.join(known, "c1").join(own, "c", "left").filter("own is null or own != d1").groupBy("person", "d1", "c").agg(F.max("other").alias("other"))
        met = seen.join(grants, ["person", "d1"]).groupBy("person", "c", "d").agg(F.max("other").alias("other"))
        counts = met.groupBy("c", "d").agg(F.count("*").alias("n"), F.sum("other").alias("m"))
        counts = cut(counts)
        rows = counts.groupBy("c").agg(F.sum("n").alias("rn"), F.sum("m").alias("rm"))
        columns = counts.groupBy("d").agg(F.sum("n").alias("cn"), F.sum("m").alias("cm"))
        alln, allm = counts.agg(F.sum("n"), F.sum("m")).first()
        if not alln:
            return links.limit(0)
        strict = F.col("c") == F.col("d") if n else F.lit(False)
        got = F.when(strict, F.col("m")).otherwise(F.col("n")).cast("double")
        by_chance = F.when(strict, F.col("rm") * F.col("cm") / float(max(allm or 0, 1))).otherwise(F.col("rn") * F.col("cn") / float(alln))
        scored = counts.join(rows, "c").join(columns, "d").select("c", "d", got.alias("n"), by_chance.alias("e")).filter((F.col("n") >= least_people) & (F.col("e") > 0))
        scored = scored.withColumn("lift", F.col("n") / F.col("e")).withColumn("g", 2 * (F.col("n") * F.log("lift") - F.col("n") + F.col("e")))
        kept = scored.filter((F.col("lift") >= (lift if n else first_lift)) & (F.col("g") >= evidence))
        chosen = kept.groupBy("c").agg(F.max(F.struct("g", "d", "lift")).alias("best")).select("c", "best.d", "best.lift")
        # what other words are linked to is a subject, and so means itself
        subject = chosen.filter(_other_words(F.col("c"), F.col("d"))).groupBy(F.col("d").alias("c")).agg(F.max("lift").alias("top"))
        links = cut(chosen.join(subject, "c", "full").select("c", F.when(F.col("top").isNull(), F.col("d")).otherwise(F.col("c")).alias("d"), F.coalesce("lift", "top").alias("lift")))
    return links
