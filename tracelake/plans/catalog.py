"""Every query of the library by name, and its SQL where SQL can express it."""

from __future__ import annotations

from tracelake.plans import conformance, filters, follows, objects, statistics

MODULES = (statistics, filters, follows, objects, conformance)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
