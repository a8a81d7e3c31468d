"""All queries of this package but the training-data operators, with their SQL."""

from __future__ import annotations

from loomtext.plans import built_queries, graph_queries, text_queries  # noqa: F401  (they register their queries)
from loomtext.plans.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
