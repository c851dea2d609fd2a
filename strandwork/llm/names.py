"""Problem 2: spellings of one person or organisation, linked by suffix blocking and common subsequences.

A spelling is read into a given part and a main part: given name or initial and surname of a person, type and place of an
organisation. Spellings that read alike are one node. Nodes become candidates when they share a suffix of their main
part; a suffix that too many nodes share is refined with the given part, then with the beginning of the main part,
and only what is still too common is given up, for keys of one deleted letter that miss no pair one letter apart.
Candidates are compared by the ratio of their longest common subsequence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm.addresses import known
from strandwork.llm.components import connected_components
from strandwork.session import cut
from strandwork.sources.tables import table

# Titles and degrees around names, short forms of given names, and the words of organisations.
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir dame lord lady rev hon phd dphil md mbbs msc mphil bsc ba ma mba mph mres pgdip frcp frs dsc rn pi jr sr ii iii esq".split())
NICKNAMES = {
    "abby": "abigail", "abbie": "abigail", "gail": "abigail", "alex": "alexander alexandra", "sandy": "alexander alexandra", "al": "albert alan alexander", "andy": "andrew", "drew": "andrew",
    "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "bella": "isabella", "izzy": "isabella", "bea": "beatrice", "beth": "elizabeth bethany", "betty": "elizabeth", "eliza": "elizabeth",
    "liz": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth", "bill": "william", "billy": "william", "will": "william", "willie": "william", "liam": "william", "bob": "robert", "bobby": "robert",
    "rob": "robert", "robbie": "robert", "bert": "robert albert", "cathy": "catherine", "chris": "christopher christine christina", "kit": "christopher katherine", "topher": "christopher", "dan": "daniel",
    "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "dot": "dorothea dorothy", "dottie": "dorothea dorothy", "dolly": "dorothea dorothy", "thea": "dorothea theodora", "dora": "dorothea theodora",
    "ed": "edmund edward edwin", "eddie": "edmund edward edwin", "ned": "edmund edward", "ted": "theodore edward edmund", "teddy": "theodore edward", "theo": "theodore", "fran": "francesca frances francis",
    "frankie": "francesca frances francis", "cesca": "francesca", "frank": "francis franklin", "fred": "frederick alfred", "freddie": "frederick alfred", "freddy": "frederick", "rick": "frederick richard", "gabi": "gabriella",
    "gabby": "gabriella", "gaby": "gabriella", "ella": "gabriella eleanor", "hettie": "henrietta", "etta": "henrietta", "harriet": "henrietta", "hank": "henry", "harry": "henry harold", "jack": "john", "jake": "jacob", "jen": "jennifer",
    "jenny": "jennifer", "jenn": "jennifer", "jim": "james", "jimmy": "james", "jo": "joanna joseph josephine", "joe": "joseph joaquin", "quin": "joaquin quentin", "jon": "jonathan", "jonny": "jonathan", "johnny": "jonathan john", "nathan": "jonathan nathaniel",
    "kate": "katherine catherine", "kathy": "katherine", "katie": "katherine", "kath": "katherine", "kitty": "katherine", "larry": "lawrence lars", "leo": "leopold leonard leonardo", "poldi": "leopold", "maggie": "margaret", "meg": "margaret",
    "peggy": "margaret", "marge": "margaret", "greta": "margaret", "rita": "margaret", "matt": "matthew", "matty": "matthew", "mick": "michael", "mickey": "michael", "mike": "michael", "mikey": "michael", "nick": "nicholas",
    "nicky": "nicholas", "nico": "nicholas", "nora": "eleanor noor", "ollie": "oliver", "noll": "oliver", "olly": "oliver", "paddy": "patrick", "pat": "patrick patricia", "penny": "penelope", "pen": "penelope", "nell": "penelope eleanor",
    "pip": "philippa philip", "pippa": "philippa", "phil": "philippa philip", "quent": "quentin", "ros": "rosalind", "roz": "rosalind", "rosie": "rosalind", "linda": "rosalind", "sam": "samuel samantha", "sammy": "samuel", "sue": "susanna susan",
    "susie": "susanna susan", "suzy": "susanna susan", "sukie": "susanna", "anna": "susanna joanna", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "tori": "victoria", "vicky": "victoria", "vic": "victoria victor", "vick": "victoria", "vik": "vikram",
    "vikki": "victoria", "walt": "walter", "wally": "walter", "wat": "walter", "yaz": "yasmin", "yas": "yasmin", "zol": "zoltan", "zoli": "zoltan", "ursa": "ursula", "uschi": "ursula", "steve": "stephen", "greg": "gregory", "ken": "kenneth",
}
ORG_TYPES = {
    "university": "university", "universities": "university", "univ": "university", "uni": "university", "u": "university", "universitaet": "university", "universite": "university", "college": "college", "institute": "institute", "institut": "institute", "inst": "institute",
    "hospital": "hospital", "hosp": "hospital", "infirmary": "hospital", "clinic": "clinic", "genomics": "genomics", "genomic": "genomics", "therapeutics": "therapeutics", "biotech": "biotech", "laboratory": "laboratory", "laboratories": "laboratory", "labs": "laboratory", "centre": "centre", "center": "centre", "foundation": "foundation", "council": "council", "trust": "trust",
}
ORG_FILLERS = frozenset("the of for and at in general gen public pub health ltd limited inc plc llc gmbh co company corp corporation school faculty medicine medical sciences science dept department div division unit epidemiology cardiology oncology neurology genetics statistics biostatistics national royal nhs".split())

_MARK = re.compile(r"\((?:pi|co-?pi|[^()]*investigator|[^()]*author)\)|\(\s*\)", re.I)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’‐-][^\W\d_]+)*")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def fold(text: str) -> str:
    """Without accents."""
    text = text.translate({0xDF: "ss", 0xF8: "o", 0xD8: "O", 0x142: "l", 0x141: "L", 0xE6: "ae", 0xC6: "AE", 0x111: "d"})
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def read_person(spelling: str) -> tuple[str, str] | None:
    """(given name or initial, surname) in lower case; None where there is no letter."""
    text = _MARK.sub(" ", fold(spelling))
    text = re.sub(r"(?<![^\W\d_])([^\W\d_])\.", r"\1 ", text)
    parts = [[t for t in _TOKEN.findall(p)] for p in text.split(",")]
    bare = [t for p in parts for t in p]
    if not bare:
        return None
    kept = [[t for t in p if t.lower() not in TITLES] for p in parts]
    # two tokens, the last in capitals: a surname and initials, even if they spell a title
    if len(bare) == 2 and len(parts) == 1 and len(bare[1]) <= 3 and bare[1].isupper() and len(bare[0]) > 3 and not bare[0].isupper() and bare[0].lower() not in TITLES:
        return bare[1][0].lower(), bare[0].lower()
    kept = [p for p in kept if p] or [bare]
    if len(kept) >= 2:
        return kept[1][0].lower(), kept[0][-1].lower()
    tokens = kept[0]
    if len(tokens) == 1:
        return "", tokens[0].lower()
    if len(tokens[-1]) <= 3 and tokens[-1].isupper() and not tokens[0].isupper():
        return tokens[-1][0].lower(), tokens[-2].lower()
    if len(tokens[-1]) == 1 and len(tokens[0]) > 1:
        rest = [t for t in tokens if len(t) > 1]
        return next(t for t in tokens[1:] if len(t) == 1).lower(), rest[-1].lower()
    if len(tokens[0]) > 2 and tokens[0].isupper() and not tokens[-1].isupper():
        return tokens[1].lower(), tokens[0].lower()
    return tokens[0].lower(), tokens[-1].lower()


def read_organisation(spelling: str) -> tuple[str, str] | None:
    """(type, place) in lower case: the part of the name that says what it is, and the rest without parts of the house."""
    text = _CAMEL.sub(" ", fold(spelling))
    segments = []
    for s in text.split(","):
        tokens = []
        for t in re.findall(r"[^\W\d_]+|\d+", s.lower()):
            glued = next((w for w in ("genomics", "university", "hospital", "institute") if t.endswith(w) and len(t) > len(w) + 3), None)
            tokens += [t[: -len(glued)], glued] if glued else [t]
        segments.append(tokens)
    if not any(segments):
        return None
    typed = [s for s in segments if any(t in ORG_TYPES for t in s)]
    kinds = sorted({ORG_TYPES[t] for s in typed for t in s if t in ORG_TYPES})
    place = [t for s in typed for t in s if t not in ORG_TYPES and t not in ORG_FILLERS] or [t for s in segments for t in s if t not in ORG_TYPES and t not in ORG_FILLERS]
    return " ".join(kinds), " ".join(place) or " ".join(t for s in segments for t in s)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    row = all_
    for c in b:
        m = where.get(c, 0)
        row = (row + (row & m)) | (row & ~m)
    return (~row & all_).bit_count()


def ratio(a: str, b: str) -> float:
    """Share of the longer word that is common in order; 1 for equal words, 0 for an empty one beside another."""
    if a == b:
        return 1.0
    return common_subsequence(a, b) / max(len(a), len(b)) if a and b else 0.0


def _one_off(a: str, b: str, least: int) -> bool:
    """At most one letter changed, doubled, left out or moved by one, in words long enough to tell."""
    longer = max(len(a), len(b))
    return a == b or (min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= 1 and ratio(a, b) > 1 - 1.5 / longer)


def _canon(given: str) -> set[str]:
    return set(NICKNAMES[given].split()) | {given} if given in NICKNAMES else {given}


def same_entity(kind: str, given_a: str, main_a: str, given_b: str, main_b: str) -> bool:
    """Whether two full readings are of one entity: one side equal (short forms allowed), the other at most one letter off."""
    if kind == "organisation":
        return given_a == given_b and _one_off(main_a, main_b, 5)
    given_equal = bool(_canon(given_a) & _canon(given_b))
    if main_a == main_b:
        return given_equal or any(_one_off(x, y, 3) for x in _canon(given_a) for y in _canon(given_b))
    if given_equal:
        return _one_off(main_a, main_b, 4)
    return given_a == main_b and given_b == main_a


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        read = [(read_organisation if k == "organisation" else read_person)(n) or (None, None) for k, n in zip(kinds, names)]
        canon = [sorted(_canon(g)) if g is not None else None for g, _ in read]
        columns = [pa.array([g for g, _ in read], pa.string()), pa.array([m for _, m in read], pa.string()), pa.array(canon, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["kind", "name", "given", "main", "canon"])


def _suffixes(word: Column, least: int) -> Column:
    size = F.length(word)
    return F.when(size <= least, F.array(word)).otherwise(F.transform(F.sequence(F.lit(1), size - least + 1), lambda i: F.substr(word, i)))


def _deletions(word: Column) -> Column:
    return F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))))


def candidate_keys(nodes: DataFrame, least_suffix: int = 4, max_block: int = 40) -> DataFrame:
    """(node, key): the blocks of each node (node, kind, given, main, canon), none of them above ``max_block`` but by keys that hardly repeat.

    1. every suffix of the main part from ``least_suffix`` letters on; 2. suffixes that more than ``max_block`` nodes share are
    refined with the given part, and whole main parts that are too common with the given part less one letter; 3. suffixes of the given
    part are common from the start and enter refined with the first letters of the main part; 4. what is still above
    ``max_block`` is discarded and its nodes get keys of one letter deleted, which every pair one edit or swap apart shares; 5. a person's
    two parts in order of the alphabet, so that a reading meets the one with its parts swapped: no more than those two nodes share it.
    """
    size = lambda keyed: keyed.groupBy("key").agg(F.count("*").alias("n"))
    base = nodes.select("node", "kind", "given", "main", F.explode("canon").alias("g"))
    first = base.select("node", "kind", "given", "main", "g", F.explode(_suffixes(F.col("main"), least_suffix)).alias("suffix"))
    plain = first.select("node", "kind", "main", "g", "suffix", F.concat_ws("|", F.lit("s"), "kind", "suffix").alias("key")).dropDuplicates(["node", "key", "g"])
    common = size(plain.select("node", "key").distinct()).filter(F.col("n") > max_block).select("key")
    kept = plain.join(common, "key", "left_anti").select("node", "key")
    refined = plain.join(common, "key", "left_semi").select("node", "kind", "main", "g", "suffix", F.concat_ws("|", F.lit("g"), "kind", "suffix", "g").alias("key"))
    # a main part shared by too many: its nodes still meet where the given parts are one letter apart
    shared = plain.filter(F.col("suffix") == F.col("main")).join(common, "key", "left_semi").select("node", F.explode(F.transform(_deletions(F.col("g")), lambda d: F.concat_ws("|", F.lit("e"), "kind", "main", d))).alias("key"))
    fronts = base.select("node", "kind", "main", "g", F.lit("").alias("suffix"), F.explode(F.array(F.substr("main", F.lit(1), F.lit(2)), F.substr("main", F.lit(1), F.lit(4)))).alias("front")).filter((F.length("front") == 4) | (F.length("main") < 8)).select("node", "kind", "main", "g", "suffix", F.concat_ws("|", F.lit("f"), "kind", "g", "front").alias("key"))
    refined = refined.unionByName(fronts)
    still = size(refined.select("node", "key").distinct()).filter(F.col("n") > max_block).select("key")
    kept2 = refined.join(still, "key", "left_anti").select("node", "key")
    rest = refined.join(still, "key", "left_semi").select("node", "kind", "main", "g").distinct()
    exact = rest.select("node", F.explode(F.transform(_deletions(F.col("main")), lambda d: F.concat_ws("|", F.lit("d"), "kind", "g", d))).alias("key"))
    swapped = nodes.filter((F.col("kind") == "person") & (F.col("given") != "")).select("node", F.concat_ws("|", F.lit("w"), "kind", F.least("given", "main"), F.greatest("given", "main")).alias("key"))
    return kept.unionByName(kept2).unionByName(shared).unionByName(exact).unionByName(swapped).distinct()


def link_names(names: DataFrame, least_suffix: int = 4, max_block: int = 40) -> DataFrame:
    """(kind, name, entity) of each distinct spelling in ``names`` (kind ``person`` or ``organisation``, name).

    Full readings are linked first; then a spelling with an initial only joins the entity of its surname (equal, else one
    letter off) and initial if there is just one, so that it never ties two people. Null, empty and "not known" names
    are left out, repeated ones count once; an empty table gives an empty result.
    """
    trimmed = names.select("kind", F.regexp_replace("name", r"(?U)^\s+|(?<!\s)\s+$", "").alias("name")).filter(known(F.col("name")).isNotNull()).distinct()
    spelled = cut(trimmed.mapInArrow(_read, "kind string, name string, given string, main string, canon array<string>").filter("main is not null and main != ''"))
    read = spelled.dropDuplicates(["kind", "given", "main"])
    nodes = cut(read.select(F.xxhash64("kind", "given", "main").alias("node"), "kind", "given", "main", "canon", ((F.col("kind") == "person") & (F.length("given") <= 1)).alias("short")))
    full = nodes.filter("not short")
    keys = cut(candidate_keys(full, least_suffix, max_block))
    a, b = keys.select(F.col("node").alias("a"), "key"), keys.select(F.col("node").alias("b"), "key")
    left = full.select(F.col("node").alias("a"), "kind", F.col("given").alias("given_a"), F.col("main").alias("main_a"))
    right = full.select(F.col("node").alias("b"), F.col("given").alias("given_b"), F.col("main").alias("main_b"))
    pairs = a.join(b, "key").filter("a < b").select("a", "b").distinct().join(left, "a").join(right, "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            keep = [same_entity(*row) for row in zip(x["kind"], x["given_a"], x["main_a"], x["given_b"], x["main_b"])]
            hits = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([hits.column(hits.schema.get_field_index("a")), hits.column(hits.schema.get_field_index("b"))], names=["u", "v"])

    links = pairs.mapInArrow(compare, "u bigint, v bigint")
    groups = connected_components(links)
    entities = cut(full.join(groups, "node", "left").select("node", "kind", "given", "main", "canon", F.coalesce("group", "node").alias("entity")))
    short = nodes.filter("short").select("node", "kind", "given", "main")
    heads = entities.select("kind", "main", "entity", F.explode("canon").alias("c")).select("kind", F.col("main").alias("of"), "entity", F.substr("c", F.lit(1), F.lit(1)).alias("given")).distinct()
    one = lambda found: found.groupBy("node").agg(F.min("entity").alias("entity"), F.max("entity").alias("top"), F.first("kind").alias("kind")).filter("entity = top").select("node", "entity")
    exact = cut(short.join(heads.withColumnRenamed("of", "main"), ["kind", "given", "main"]))
    attached = one(exact)
    # surnames that no full reading has: one letter off, by the shared keys of one deleted letter
    lone = short.join(exact.select("node").distinct(), "node", "left_anti")
    near = lambda df, word: df.withColumn("d", F.explode(_deletions(F.col(word))))
    off = near(lone, "main").join(near(heads, "of"), ["kind", "given", "d"]).filter((F.length("main") >= 5) & (F.abs(F.length("main") - F.length("of")) <= 1)).select("node", "kind", "entity").distinct()
    entity = entities.select("node", "entity").unionByName(attached).unionByName(one(off))
    named = nodes.join(entity, "node", "left").select("kind", "given", "main", F.coalesce("entity", "node").alias("entity"))
    return spelled.join(named, ["kind", "given", "main"]).select("kind", "name", "entity")


def spelling_pairs(linked: DataFrame) -> DataFrame:
    """(name_kind, name_a, name_b), name_a before name_b, of the different spellings of each entity."""
    a = linked.select("kind", "entity", F.col("name").alias("name_a"))
    b = linked.select("kind", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["kind", "entity"]).filter("name_a < name_b").select(F.col("kind").alias("name_kind"), "name_a", "name_b")


def typed_names(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name) of everything the statement names."""
    repos = table(spark, folder, "ukb_dmca_repositories")
    authors = F.split("paper_authors", r"[;|]")
    entry = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    empty = F.array().cast("array<string>")
    found = repos.select(F.inline(F.concat(
        entry("person", F.coalesce(authors, empty)), entry("person", F.array("repo_owner_public_name")), entry("organisation", F.array("repo_owner_public_company"))
    )))
    leads = table(spark, folder, "application_level_leakage").select(F.lit("person").alias("kind"), F.col("application_pi").alias("name"))
    return found.unionByName(leads).filter("name is not null")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_pairs(link_names(typed_names(spark, folder)))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """How many entities have how many spellings."""
    linked = link_names(typed_names(spark, folder))
    return linked.groupBy("kind", "entity").agg(F.count("*").alias("spellings")).groupBy("kind", "spellings").agg(F.count("*").alias("entities"))


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
ORACLE_SQL: dict[str, str] = {}
