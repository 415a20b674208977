"""All general queries and their SQL."""

from __future__ import annotations

from tidemill.plans import aggregates, corpus, relational, scalars
from tidemill.streaming import events

QUERIES = {**relational.QUERIES, **aggregates.QUERIES, **scalars.QUERIES, **corpus.QUERIES, **events.QUERIES}
SQL = {**relational.SQL, **aggregates.SQL, **scalars.SQL, **corpus.SQL, **events.SQL}
