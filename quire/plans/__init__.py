"""Queries over the driver's tables by name, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from . import exports, geometry, jobs, layout, oracles, quality, readings, service, tables, text

MODULES = (text, geometry, layout, tables, quality, jobs, exports, service, readings)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in (*MODULES, oracles) for k, v in m.ORACLES.items()}
