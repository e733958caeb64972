"""All queries of the sub-package and their SQL."""

from __future__ import annotations

from corpusloom.llm import p1, p2, p5, p6, p7, p8, p9, p10

_MODULES = (p1, p2, p5, p6, p7, p8, p9, p10)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
