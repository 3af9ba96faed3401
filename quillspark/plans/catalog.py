"""All core queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import corpus_queries, document_queries, hierarchy_queries, retrieval_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (hierarchy_queries, text_queries, corpus_queries, retrieval_queries, document_queries)

QUERIES: dict[str, Query] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
