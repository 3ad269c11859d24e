"""All registered queries; importing a module registers its own."""

from shelfledger.plans import (audit_queries, catalog_queries, history_queries, maintain_queries, matrix_queries, payload_queries,
                               sink_queries, stream_queries, text_queries)
from shelfledger.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "audit_queries", "catalog_queries", "history_queries", "maintain_queries", "matrix_queries",
           "payload_queries", "sink_queries", "stream_queries", "text_queries"]
