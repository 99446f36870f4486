"""Registry of the log engine's queries."""

from __future__ import annotations

from spindrift.plans import q_catalog, q_ingest, q_search

flagship = q_search.flagship


def queries() -> dict:
    return {**q_search.QUERIES, **q_catalog.QUERIES, **q_ingest.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**q_search.SQL, **q_catalog.SQL, **q_ingest.SQL}
