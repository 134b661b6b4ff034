"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

ALNUM_START = "^[\\s\"''“”‘’(\\[{—–\\-…]+"


def key_sql(value: str, kind: str) -> str:
    """The SQL of ``functions.keys.normalize_key``."""
    t = f"upper(trim({value}))"
    tf = f"coalesce({kind} = 'certo_errado', false)"
    return (
        f"CASE WHEN {t} IN ('X','ANULADA','ANULADO') THEN 'Anulada' WHEN {tf} AND {t} IN ('CERTO','C') THEN 'Certo' "
        f"WHEN {tf} AND {t} IN ('ERRADO','E') THEN 'Errado' WHEN NOT {tf} AND {t} IN ('A','B','C','D','E') THEN {t} END"
    )
