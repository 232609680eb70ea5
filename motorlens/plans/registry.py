"""All queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from motorlens.plans import crawl_queries, market_queries, page_queries, photo_queries, state_queries, text_queries

QUERIES = {**market_queries.QUERIES, **text_queries.QUERIES, **state_queries.QUERIES, **page_queries.QUERIES, **crawl_queries.QUERIES, **photo_queries.QUERIES}
ORACLES = {**market_queries.ORACLES, **text_queries.ORACLES, **state_queries.ORACLES, **page_queries.ORACLES, **crawl_queries.ORACLES, **photo_queries.ORACLES}
