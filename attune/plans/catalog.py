"""All queries: importing this module fills the registry."""

from __future__ import annotations

from attune.plans import aggregates, battles, filters, joins, logs, models, ranks, scalars, statistics, streams, texts, vectors
from attune.plans.registry import ORACLES, QUERIES

MODULES = (aggregates, battles, filters, joins, logs, models, ranks, scalars, statistics, streams, texts, vectors)
__all__ = ["MODULES", "ORACLES", "QUERIES"]
