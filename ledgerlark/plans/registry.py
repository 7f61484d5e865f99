"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from ledgerlark.plans import aggregates, evidence, ledger, lookups, pages, pairs, sources, streams, texts  # noqa: F401
from ledgerlark.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
