"""The registry of queries and of their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("bank", "exams", "linkage", "texts", "segments", "documents", "history", "curation", "layout", "printed", "review")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quaestio.plans.{name}").query, attribute)
    return out


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("sql")
