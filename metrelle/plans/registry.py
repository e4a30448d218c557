"""The registered queries and their oracles, by name."""

from __future__ import annotations

from metrelle.plans import scoring_queries, table_queries

QUERIES: dict = {**scoring_queries.QUERIES, **table_queries.QUERIES}
ORACLES: dict = {**scoring_queries.ORACLES, **table_queries.ORACLES}
