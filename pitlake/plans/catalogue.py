"""All queries of the core, with their SQL."""

from __future__ import annotations

from pitlake.plans import feeds, machines, points, portfolio, records, registry, relational, research, scores, sleeves, statements, streams, texts, valuation, windows  # noqa: F401

QUERIES = dict(records.QUERIES) | registry.QUERIES
ORACLES = dict(records.ORACLES) | registry.ORACLES
