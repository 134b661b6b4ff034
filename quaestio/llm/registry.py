"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "p01_signature_tree",
    "p02_confusables",
    "p03_encoding",
    "p04_canonical",
    "p05_scans",
    "p06_copies",
    "p07_truncated",
    "p08_leaks",
    "p09_mixture",
    "p10_personal",
]


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"quaestio.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
