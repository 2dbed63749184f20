"""All queries of the engine and, where SQL can express them, their SQL."""

from . import aggregate_queries, continuity_queries, graph_queries, report_queries, sql_queries, state_queries, store_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
