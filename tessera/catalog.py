"""All queries of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.plans import assets, audits, catalogues, evidence, flows, matching, more, proofs, reports, scores, trials  # noqa: F401  each registers its queries
from tessera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
