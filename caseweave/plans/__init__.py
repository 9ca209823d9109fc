"""The registered queries of the library, and the SQL that gives the same rows."""

from __future__ import annotations

from . import documents, events, orders, pages, review, streams

QUERIES = documents.QUERIES | orders.QUERIES | pages.QUERIES | events.QUERIES | review.QUERIES | streams.QUERIES
ORACLES = documents.ORACLES | orders.ORACLES | pages.ORACLES | events.ORACLES | review.ORACLES | streams.ORACLES
