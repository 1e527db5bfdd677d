"""All registered queries of the engine proper, with their DuckDB counterparts."""

from __future__ import annotations

from sparkloom.plans import answers, audit, indexing, registry, web

MODULES = (answers, audit, indexing, web)
QUERIES: dict = registry.QUERIES
ORACLES: dict = registry.ORACLES
