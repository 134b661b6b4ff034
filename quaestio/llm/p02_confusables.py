"""Problem 2: text that looks the same in different characters.

The skeleton of a text: decompose, replace each character by its prototype from the look-alike table,
decompose again. Texts of equal skeleton look alike and form one group. The table follows rules for
whole blocks (full-width forms, ligatures, mathematical letters, spaces, invisible characters) and lists
single letters of Greek, Cyrillic, Armenian and unusual Latin. A value is disguised where its skeleton,
composed again and rid of marks that belong to no letter, isn't the value itself; an exact test of its
characters follows, as letters of another script are no disguise in a word of their own. The consistent
form uses the same prototypes, but spares words and symbols wholly of another script.

Defined cases: null values are left out; an empty text is its own form; values that problem 3 reports
as garbled are no cases here; equal values get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.llm.p03_encoding import garbled
from quaestio.llm.texts import OPTION, STEM, fields
from quaestio.session import materialize

#: Look-alikes of Latin letters, in alphabetical order of the Latin prototype.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухһԁԛԝҮүӏ", "ABESIJKMHOPCTYX3aesijopcyxhdqwYyl")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιϳκνορτυχγωϲ", "ABEZHIKMNOPTYXaijkvoptuxywc")
ARMENIAN = ("ՕՏՍԼօոսհցզյ", "OSULonuhgqj")
UNUSUAL_LATIN = ("ıɑɡɩℓ", "iagil")
#: ASCII characters that look alike, used for skeletons only.
ASCII_ALIKE = {"0": "O", "1": "l", "I": "l", "|": "l"}
HOMOGLYPHS = {ord(a): b for pair in (CYRILLIC, GREEK, ARMENIAN, UNUSUAL_LATIN) for a, b in zip(*pair, strict=True)}
#: What may hold a character that has a prototype: all but the first two blocks, common dashes, quotes, dots and the ellipsis.
_SUSPECT = r"[^\x00-\x9F¡-¬®-ÿ‐-—‘-„•…]"
_WORD = re.compile(r"\w+")
SCRIPTS = {"GREEK", "CYRILLIC", "ARMENIAN"}  # with letters that look like Latin ones


def kind(c: str) -> str | None:
    """The class of a character that has a prototype by rule, beside the listed letters."""
    o = ord(c)
    if o < 0xA0:
        return None
    if 0xFF01 <= o <= 0xFF5E or 0xFFE0 <= o <= 0xFFE6:
        return "largura"
    if 0xFB00 <= o <= 0xFB06 or o in (0x132, 0x133):
        return "ligadura"
    if 0x1D400 <= o <= 0x1D7FF:
        return "matematica"
    category = unicodedata.category(c)
    if category == "Zs":
        return "espaco"
    if category == "Cf" or o in (0x115F, 0x1160, 0x3164) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F:
        return "invisivel"
    if category == "Mn":
        return "acento"
    return None


class Prototypes(dict):
    """A translation table that fills itself by rule; ``letters`` are listed look-alikes."""

    def __init__(self, letters: dict[int, str]):
        super().__init__(letters)

    def __missing__(self, o: int):
        c = chr(o)
        k = kind(c)
        new = {"espaco": " ", "invisivel": ""}.get(k)
        if k in ("largura", "ligadura", "matematica"):
            new = unicodedata.normalize("NFKD", c)
        self[o] = c if new is None else new
        return self[o]


_SHAPES = Prototypes({})
_PROTOTYPES = Prototypes(HOMOGLYPHS)
_SKELETON = Prototypes({**HOMOGLYPHS, **{ord(a): b for a, b in ASCII_ALIKE.items()}})


def skeleton(text: str) -> str:
    once = unicodedata.normalize("NFD", text).translate(_SKELETON)
    return unicodedata.normalize("NFD", once.translate(_SKELETON))


def _script(c: str) -> str:
    if c.isascii():
        return "LATIN" if c.isalpha() else ""
    return unicodedata.name(c, "").split(" ", 1)[0] if c.isalpha() else ""


def _foreign(word: str, others: set[str]) -> bool:
    """Whether a letter of one of the other scripts stands beside a Latin one."""
    if word.isascii():
        return False
    scripts = {_script(c) for c in word}
    return "LATIN" in scripts and bool(scripts & others)


def consistent(text: str) -> str:
    """The consistent form: prototypes of shapes, Latin for look-alike letters in Latin words, composed."""
    shaped = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SHAPES))
    if shaped.isascii():
        return shaped
    return _WORD.sub(lambda m: m.group().translate(HOMOGLYPHS) if _foreign(m.group(), SCRIPTS) else m.group(), shaped)


def unlike(text: str) -> bool:
    """Whether the skeleton of a text, composed again, differs from the text. ASCII look-alikes are left alone."""
    folded = unicodedata.normalize("NFD", text).translate(_PROTOTYPES)
    composed = unicodedata.normalize("NFC", folded)
    return composed != text or any(unicodedata.category(c) == "Mn" for c in composed if not c.isascii())


def kinds(text: str) -> list[str]:
    """The classes of disguised characters in a text, sorted."""
    found = {k for c in text if not c.isascii() and (k := kind(c))} - {"matematica"}
    plain = text.translate(_SHAPES) if found else text
    if any(_foreign(w, {"GREEK", "CYRILLIC"}) for w in _WORD.findall(plain)):
        found.add("alfabeto")
    return sorted(found)


def inspected(values: DataFrame) -> DataFrame:
    """Values that differ from their skeleton, with a disguised character: (campo, registro_id, texto, classes, forma)."""

    def look(text: pd.Series) -> pd.DataFrame:
        other = [unlike(t) for t in text]
        return pd.DataFrame({"classes": [kinds(t) if u else [] for t, u in zip(text, other, strict=True)], "forma": [consistent(t) if u else t for t, u in zip(text, other, strict=True)]})

    udf = F.pandas_udf(look, "classes array<string>, forma string")
    out = values.where(F.col("texto").rlike(_SUSPECT)).withColumn("r", udf("texto"))
    return out.select("campo", "registro_id", "texto", "r.*").where("size(classes) > 0")


def disguised(values: DataFrame) -> DataFrame:
    """``inspected`` without the values that are garbled by a wrong encoding."""
    seen = materialize(inspected(values))
    return seen.join(garbled(seen.select("campo", "registro_id", "texto"), values), ["campo", "registro_id"], "left_anti")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that their skeleton shows to be disguised."""
    return disguised(fields(spark, sf_dir, STEM, OPTION)).select("campo", "registro_id")


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in its consistent form."""
    form = F.pandas_udf(lambda s: s.map(consistent), "string")
    values = fields(spark, sf_dir, STEM, OPTION)
    may = F.col("texto").rlike(_SUSPECT)
    odd = values.where(may).withColumn("texto", form("texto"))
    return odd.unionByName(values.where(~may)).withColumnRenamed("texto", "texto_normal")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal skeleton with more than one spelling: (campo, esqueleto, n_registros, n_grafias, registro_id)."""
    skel = F.pandas_udf(lambda s: s.map(skeleton), "string")
    values = fields(spark, sf_dir, STEM, OPTION).select("campo", "registro_id", F.md5("texto").alias("g"), F.md5(skel("texto")).alias("esqueleto"))
    spelled = values.groupBy("campo", "esqueleto", "g").agg(F.count("*").alias("n"), F.min("registro_id").alias("primeiro"))
    groups = spelled.groupBy("campo", "esqueleto").agg(
        F.sum("n").alias("n_registros"), F.count("*").alias("n_grafias"), F.min("primeiro").alias("registro_id")
    )
    return groups.where("n_grafias > 1")


QUERIES = {"p2_found": p2_found, "p2_normalized": p2_normalized, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
