"""All queries of the engine with their SQL: importing the modules registers them."""

from __future__ import annotations

from quernstone import account_queries, answer_queries, bank_queries, content_queries, content_rules_queries, graph_queries, ingest_queries, patch_queries, policy_queries, relation_queries, shape_queries, tracing_queries  # noqa: F401
from quernstone.registry import ORACLE_SQL, QUERIES  # noqa: F401
