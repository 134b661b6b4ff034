"""Column functions over answer keys and question numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaestio.schemas import KINDS

LETTERS = ("A", "B", "C", "D", "E")
TF = KINDS[1]


def normalize_key(value: Column, kind: Column) -> Column:
    """A key in the vocabulary of the domain, or null.

    Blanks around and letter case are ignored. Void markers hold for any kind; C and E mean true and
    false only for true/false questions, A to E only for others (a null kind counts as other).
    """
    token = F.upper(F.trim(value))
    is_tf = F.coalesce(kind == TF, F.lit(False))
    return (
        F.when(token.isin("X", "ANULADA", "ANULADO"), "Anulada")
        .when(is_tf & token.isin("CERTO", "C"), "Certo")
        .when(is_tf & token.isin("ERRADO", "E"), "Errado")
        .when(~is_tf & token.isin(*LETTERS), token)
    )


def is_key_token(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)).isin(*LETTERS, "CERTO", "ERRADO", "ANULADA", "X"), F.lit(False))


def official_number(raw: Column) -> tuple[Column, Column]:
    """(number, reason) of a number given as text: only canonical positive integers count."""
    text = F.trim(raw)
    number = text.try_cast("int")
    missing = raw.isNull() | (text == "")
    bad = number.isNull() | (number <= 0) | (number.cast("string") != text)
    reason = F.when(missing, "numeracao_ausente").when(bad, "numeracao_invalida")
    return F.when(reason.isNull(), number), reason


def bulk_tokens(text: Column) -> Column:
    """Whole answer tokens of a pasted text; letters inside words are none."""
    spaced = F.regexp_replace(F.upper(text), r"[^\p{L}]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t.isin(*LETTERS, "CERTO", "ERRADO"))
