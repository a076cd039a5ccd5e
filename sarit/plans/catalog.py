"""All queries of the core by name, and their SQL: each runs an operator over its whole tables."""

from __future__ import annotations

from sarit.plans import corpus_queries, model_queries

QUERIES: dict = {**corpus_queries.QUERIES, **model_queries.QUERIES}
ORACLE: dict = {**corpus_queries.ORACLE, **model_queries.ORACLE}
