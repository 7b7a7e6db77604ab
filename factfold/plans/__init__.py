"""Composed pipelines, input views and the registered queries."""

from factfold.plans import (
    consensus_queries, function_queries, monitor_queries, retrieval_queries, sync_queries,
)

QUERY_MODULES = (consensus_queries, function_queries, retrieval_queries, sync_queries, monitor_queries)
