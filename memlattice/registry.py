"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import knowledge, records, state, wording  # noqa: F401  their queries join the catalog's
from .plans.catalog import ORACLES, QUERIES

FLAGSHIP = "hybrid_search_full"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
