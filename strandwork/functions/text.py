"""Text functions on columns: normalising, tokens, identifiers, addresses, markup and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words that say little.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "into", "using", "are", "was", "were", "has", "have", "not", "but", "its", "our")
# Texts that stand for a missing value.
MISSING = ("", "nan", "na", "n/a", "none")


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*MISSING), t)


def squash(c: Column) -> Column:
    """Runs of white space of any kind as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def whole_or_zero(c: Column) -> Column:
    """A whole number, 0 for anything else; ``1.0`` isn't whole."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint")), F.lit(0).cast("bigint"))


def real_or_null(c: Column) -> Column:
    """A number with or without decimals, null for anything else; ``nan``, exponents and thousands separators aren't read."""
    return F.when(F.trim(c).rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$"), F.trim(c).try_cast("double"))


def fixed(c: Column, digits: int) -> Column:
    """A number as text with ``digits`` decimals; null and NaN give null."""
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.format_string(f"%.{digits}f", c.cast("double")))


def plain(c: Column) -> Column:
    """Lower case, ``&`` as ``and``, everything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def ascii_plain(c: Column) -> Column:
    """As ``plain`` after taking accents off the Latin letters that have them; letters of two sounds become two."""
    t = F.lower(c)
    # Letters and what they become.
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ð", "d")):
        t = F.replace(t, F.lit(letter), F.lit(pair))
    return plain(F.translate(t, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžłđ", "aaaaaaceeeeiiiinoooooouuuuyyszld"))


def split_camel(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2")


def tokens(c: Column, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of at least ``least`` letters or digits, without stop words, in order of appearance."""
    found = F.regexp_extract_all(F.lower(split_camel(c)), F.lit(rf"[a-z0-9]{{{least},}}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop]))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over those of the smaller list, 0 if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), least), F.lit(0.0))


def identifiers(c: Column, kind: str) -> Column:
    """Distinct identifiers of a kind, without trailing punctuation, in order of appearance."""
    # What identifiers look like.
    patterns = {"doi": r"10\.\d{4,9}/[^\s\"<>|]+", "number": r"\d{2,8}", "sha": r"(?i)[0-9a-f]{40}", "url": r"https?://[^\s\"<>)\]]+"}
    found = F.regexp_extract_all(c, F.lit(patterns[kind]), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:)]+$", "")))


def split_unique(c: Column, pattern: str = r"[;|,]") -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != ""))


def snippet(c: Column, start: Column, length: int, width: int) -> Column:
    """``width`` characters on both sides of a hit that starts at ``start`` (from 1), with ellipses where text is cut."""
    a = F.greatest(start - width, F.lit(1))
    b = F.least(start + length + width, F.length(c) + 1)
    return F.concat(F.when(a > 1, "...").otherwise(""), F.substr(c, a, b - a), F.when(b <= F.length(c), "...").otherwise(""))


def strip_markup(c: Column) -> Column:
    """HTML and Markdown to text: scripts, tags, code fences, link targets and emphasis go; common entities are resolved."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^<>]+>", " ")
    t = F.regexp_replace(t, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"[*`#>]+", "")
    # Entities.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def name_in_tokens(person: Column, words: Column) -> Column:
    """Whether words hold a person's last name and the first name or its initial."""
    parts = F.regexp_extract_all(F.lower(person), F.lit(r"[a-z]+"), F.lit(0))
    last, first = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(1))
    return F.coalesce(F.array_contains(words, last) & (F.array_contains(words, first) | F.array_contains(words, F.substr(first, F.lit(1), F.lit(1)))), F.lit(False))


def rule_hits(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Array of (order, rule, position, hit) of the first match of every rule that matches, in the order of the rules."""
    hits = [F.struct(F.lit(i).alias("order"), F.lit(name).alias("rule"), F.regexp_instr(c, F.lit(p)).alias("position"), F.regexp_extract(c, p, 0).alias("hit")) for i, (name, p) in enumerate(rules)]
    return F.filter(F.array(*hits), lambda h: h["position"] > 0)


def near(c: Column, a: str, b: str, within: int) -> Column:
    """Whether matches of two patterns lie within so many characters of each other."""
    gap = rf"[\s\S]{{0,{within}}}?"
    return c.rlike(f"(?:{a}){gap}(?:{b})|(?:{b}){gap}(?:{a})")
