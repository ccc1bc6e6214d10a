"""Every registered query, by area."""

from tidewright.catalogue import (  # noqa: F401
    catalog_queries,
    extraction_queries,
    file_queries,
    flow_queries,
    grouping_queries,
    health_queries,
    rewrite_queries,
    snapshot_queries,
    store_queries,
    streaming_queries,
    usage_queries,
)
from tidewright.catalogue.registry import QUERIES

__all__ = ["QUERIES"]
