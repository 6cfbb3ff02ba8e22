"""All named queries of the civic-records engine, with their SQL twins."""

from __future__ import annotations

# importing a module registers its queries
from rostra.plans import audits, core, documents, integrity, packing, records, scalars, search, seats, summaries  # noqa: F401
from rostra.plans.civic import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
