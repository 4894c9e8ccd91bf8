"""All queries of the record-resolution operators, and their SQL."""

from __future__ import annotations

from .queries import entities, rules, structure, text, whole

MODULES = (structure, text, entities, rules, whole)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
