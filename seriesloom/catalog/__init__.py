"""Views over the given tables, the registered queries and their SQL."""

from seriesloom.catalog import (  # noqa: F401
    evaluation_queries,
    model_queries,
    panel_queries,
    source_queries,
)
from seriesloom.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
