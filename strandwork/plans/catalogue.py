"""The modules that hold queries and the SQL they are checked against."""

from __future__ import annotations

from strandwork.plans import aggregates, calendar, crosswalks, estimates, exchange, linkage, models, problems, relational, streams, texts


def modules() -> list:
    return [problems, relational, aggregates, calendar, texts, models, linkage, streams, exchange, crosswalks, estimates]
