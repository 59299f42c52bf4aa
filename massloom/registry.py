"""All queries of the library over the driver's tables, and their SQL."""

from .plans import policy_queries, search_queries  # noqa: F401  add their queries
from .plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
