"""The modules of this package that hold queries and their SQL."""

from __future__ import annotations

from strandwork.llm import groups, names, passages, residue, tokens, topics, truth


def modules() -> list:
    return [truth, names, topics, groups, tokens, passages, residue]
