"""Named queries over the driver tables, each with its SQL."""

from __future__ import annotations

from wadi.plans import activity, concepts, corpus, lookup, quality, references, retrieval, sequences, session, shaping, sounds, streams, understanding

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (retrieval, corpus, lookup, quality, activity, sequences, understanding, shaping, session, concepts, streams, references, sounds):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
