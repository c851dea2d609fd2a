"""Repository addresses in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for "not known".
UNKNOWN = ("unknown", "unresolved", "tbd", "tbc", "none", "not found", "not known", "n/a", "na", "nan", "null", "-", "--", "?", "??", "deleted", "404", "repository unavailable", "pending", "missing", "")

_SPACES = r"(?U)^\s+|(?<!\s)\s+$"


def known(text: Column) -> Column:
    """Trimmed lower-case text, null for blanks and words that stand for "not known"."""
    t = F.lower(F.regexp_replace(text, _SPACES, ""))
    return F.when(~t.isin(*UNKNOWN), t)


def repository(text: Column) -> Column:
    """``owner/name`` in lower case of a repository however its address is written, null unless both are there.

    Understood are web addresses with or without scheme, ``www.`` and ``raw.`` hosts, ``git@host:`` and ``ssh://``
    addresses, bare ``owner/name`` (blanks around the slash allowed), and whatever path, ``.git``, query or fragment follows.
    """
    t = known(text)
    t = F.regexp_replace(t, r"[?#].*$", "")
    t = F.regexp_replace(t, r"(?U)\s*/\s*", "/")
    web = r"^(?:git\+)?(?:[a-z]+://)?(?:[^@/\s]+@)?(?:[a-z0-9-]+\.)++[a-z]{2,}(?::\d+)?[/:]+([^/\s:]+)/+([^/\s]+?)(?:\.git)?(?:/.*)?$"
    bare = r"^([^/\s:@]+)/([^/\s:]+?)(?:\.git)?/*$"
    pick = lambda p: F.concat(F.regexp_extract(t, p, 1), F.lit("/"), F.regexp_extract(t, p, 2))
    # "owner.with.dot/name" has two parts; a host has at least an owner and a name behind it
    return F.when(t.rlike(web), pick(web)).when(t.rlike(bare), pick(bare))


SQL_UNKNOWN = "(" + ", ".join(f"'{w}'" for w in UNKNOWN) + ")"
_WEB = r"'^(?:git\+)?(?:[a-z]+://)?(?:[^@/\s]+@)?(?:[a-z0-9-]+\.)+[a-z]{2,}(?::\d+)?[/:]+([^/\s:]+)/+([^/\s]+?)(?:\.git)?(?:/.*)?$'"
_BARE = r"'^([^/\s:@]+)/([^/\s:]+?)(?:\.git)?/*$'"


def sql_repository(column: str) -> str:
    """The same in SQL."""
    t = rf"regexp_replace(regexp_replace(lower(trim({column})), '[?#].*$', ''), '\s*/\s*', '/', 'g')"
    return (
        f"CASE WHEN lower(trim({column})) IN {SQL_UNKNOWN} THEN NULL WHEN regexp_matches({t}, {_WEB}) THEN regexp_extract({t}, {_WEB}, 1) || '/' || regexp_extract({t}, {_WEB}, 2) "
        f"WHEN regexp_matches({t}, {_BARE}) THEN regexp_extract({t}, {_BARE}, 1) || '/' || regexp_extract({t}, {_BARE}, 2) END"
    )
