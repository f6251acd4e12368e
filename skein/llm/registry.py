"""The queries of this subpackage by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util

_PARTS = ("topn", "canonical", "encode", "pack", "neardup", "similar", "overlap", "abuse")


def _modules() -> list:
    return [importlib.import_module(f"skein.llm.{p}_queries") for p in _PARTS if importlib.util.find_spec(f"skein.llm.{p}_queries")]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
