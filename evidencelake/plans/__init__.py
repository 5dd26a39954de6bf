"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from evidencelake.plans import answers, facts, records, texts

_MODULES = (facts, texts, answers, records)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
