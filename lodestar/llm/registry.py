"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE: dict = {}
for _name in ("queries_items", "queries_text"):
    try:
        _m = import_module(f"lodestar.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"lodestar.llm.{_name}":
            raise
        continue
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
