"""Column functions over text; all are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Portuguese and what remains without the accent.
ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"


def page_normal(text: Column) -> Column:
    """A page in compatible composed form (NFKC), with one kind of line end and single blanks."""

    def compatible(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    lines = F.regexp_replace(F.pandas_udf(compatible, "string")(text), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+", " "), r"^\s+|\s+\z", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparison_text(text: Column) -> Column:
    """For comparing: words split at line ends joined, signs and blanks to one space, ß as ss, lower case."""
    joined = F.regexp_replace(text, r"(\p{L})-\s*\n\s*(\p{L})", "$1$2")
    return F.trim(F.regexp_replace(F.replace(F.lower(joined), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def accent_key(text: Column) -> Column:
    return squeeze(F.lower(F.translate(text, ACCENTED, PLAIN)))


def key_tokens(label: Column, stop: tuple[str, ...]) -> Column:
    """Distinct sorted words of a label without accents, stop words and single letters."""
    words = F.regexp_extract_all(accent_key(label), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def clean_page(text: Column) -> Column:
    """A page without non-breaking spaces, split words, blank lines, encoded tokens and watermarks."""
    t = F.regexp_replace(F.translate(text, " ", " "), r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")
    kept = F.filter(F.transform(lines(t), squeeze), lambda x: (x != "") & ~x.rlike(r"^[A-Za-z0-9+/=]{40,}$") & ~x.rlike(r"(?i)^(?:pcimarkpci|www\.)\S*$"))
    return F.array_join(kept, "\n")


def is_answer_grid(line: Column) -> Column:
    numbers = F.size(F.regexp_extract_all(line, F.lit(r"(\b\d{1,3}\b)"), F.lit(1)))
    return (numbers >= 5) & ~line.rlike(r"[\p{L}]{3,}")


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def suspicious_start(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, "^[\\s\"'“”‘’(\\[{—–\\-…]+", "").rlike(r"^\p{Ll}"), F.lit(False))


def version_label(label: Column) -> Column:
    """The number of a booklet version: words before it and Roman numerals are read."""
    bare = F.upper(F.regexp_replace(F.trim(label), r"(?i)^(?:prova\s+tipo|prova|tipo|t)\s*", ""))
    roman = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "X": "10"}
    out = bare
    for k, v in roman.items():
        out = F.when(bare == k, v).otherwise(out)
    return out


def roman_items_on_lines(text: Column) -> Column:
    """Each item of a Roman list on a line of its own."""
    return F.regexp_replace(text, r"[ \t]+((?:I|II|III|IV|V)[ ]?[–-][ ])", "\n$1")


#: An option letter in brackets or before one, that is no part of a word; what stands before it, and the letter.
OPTION_SIGN = r"(^|[^\p{L}\p{N}_(])(\(?[A-Ea-e]\)\s+)"
OPTION_LETTER = r"(?:^|[^\p{L}\p{N}_(])\(?([A-Ea-e])\)\s"


def options_on_lines(line: Column) -> Column:
    """The options of one line each on a line of its own, if there are two at least, in order, none twice, all of one case."""
    letters = F.regexp_extract_all(line, F.lit(OPTION_LETTER), F.lit(1))
    upper = F.transform(letters, F.upper)
    cases = F.size(F.array_distinct(F.transform(letters, lambda x: x == F.upper(x))))
    ok = (F.size(letters) >= 2) & (upper == F.array_sort(F.array_distinct(upper))) & (cases == 1)
    return F.when(ok, F.regexp_replace(line, OPTION_SIGN, "$1\n$2")).otherwise(line)


def blanks_on_lines(text: Column) -> Column:
    """Items with a blank to fill in, each after an empty line, where a text asks for true or false of two at least."""
    asked = text.rlike("(?i)verdadeir[oa]") & text.rlike("(?i)fals[oa]")
    several = F.size(F.regexp_extract_all(text, F.lit(r"(\(\s*\))"), F.lit(1))) >= 2
    apart = F.regexp_replace(F.regexp_replace(text, r"\s*\(\s*\)\s*", "\n\n(  )  "), r"^\s+|\s+$", "")
    return F.when(asked & several, F.regexp_replace(apart, r"([.!?])\s+((?:Assinale|Marque|Selecione)\b)", "$1\n\n$2")).otherwise(text)
