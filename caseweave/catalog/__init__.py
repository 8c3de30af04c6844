"""All named queries over the test tables."""

from caseweave.catalog import contagion, models, relational, search, sources, text  # noqa: F401
from caseweave.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
