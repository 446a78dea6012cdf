"""All queries of the geometric engine and their oracles."""

from __future__ import annotations

from voxloom.plans import aggregates, codecs, joins, projections

PARTS = (projections, joins, aggregates, codecs)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.catalog.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.catalog.oracles.items()}
