"""Problem 4: freely typed values mapped to a canonical list by a prefix-filter set-similarity join.

Distinct values, not rows, are mapped. A value gives variants: the whole, its segments between
separators, segments swapped, each with its abbreviations and numerals as typed and as the words of
every name that has words for them. Variants and list names become sets of padded 3-grams, ordered by
global rarity. Only grams of the prefix are joined, with filters on length and position; candidates are
verified by exact Jaccard similarity, then word by word with few edits, and the best entry is kept: the
one with the least cost of edits, spare and missing words, then the greatest similarity. Values without
one get 0.

Defined cases: null and blank values and exact names are left out; of equal candidates the smallest
ref_id wins; an empty list maps every value to 0; an empty table gives an empty result. The list is
the stated query set: it is worked off in blocks of ``LIST_BLOCK`` entries.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.llm.texts import join_counted
from quaestio.session import materialize, table

FIELDS = ("disciplina", "banca", "cargo")
NUM, DEN = 1, 4  # least Jaccard similarity of 3-grams
LIST_BLOCK = 20_000
#: Small numbers as the list writes them.
NUMERALS = {"1": "i", "2": "ii", "3": "iii", "4": "iv", "5": "v"}
FILLERS = {"a", "as", "da", "das", "de", "do", "dos", "e", "em", "o", "os", "para"}
_SEPARATOR = re.compile(r"\s+[-–—|]\s+|\s*[/:;()\[\],]\s*|\s[-–—]|[-–—]\s")
_GENDER = re.compile(r"\((?:a|as|o|os)\)", re.IGNORECASE)
_INITIALS = re.compile(r"\b(?:\w\.){2,}\w?\.?")


def plain(text: str) -> str:
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def tidy(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text))


class Names:
    """The names of one field, found by any beginning of one of their words."""

    def __init__(self, names: list[str]):
        self.words: list[list[str]] = []
        self.by_start: dict[str, set[int]] = defaultdict(set)
        for n in sorted(set(names)):
            # words between spaces; those with a hyphen also by their parts
            words = tidy(n).split()
            whole = [tidy(w).replace(" ", "") for w in n.split()]
            for form in {tuple(words), tuple(w for w in whole if w)}:
                for w in form:
                    for k in range(1, len(w) + 1):
                        self.by_start[w[:k]].add(len(self.words))
                self.words.append(list(form))

    def readings(self, words: list[str]) -> set[str]:
        """The typed words with abbreviations (that end in a full stop) and numerals read as words of a name.

        One reading for each name that has a word for any of them: a name agrees only if its words are met
        in order, so each abbreviation is its next word that begins so. Words no name has stay as typed.
        """
        short = [(w.rstrip(".-"), w.endswith(".") and w.rstrip(".-").isalpha()) for w in words]
        out = {" ".join(w for w, _ in short)}
        met = set().union(*(self.by_start.get(w, ()) if cut else self.by_start.get(NUMERALS.get(w, ""), ()) for w, cut in short))
        for k in met:
            name, at, read = self.words[k], 0, []
            for w, cut in short:
                if cut:
                    j = next((j for j in range(at, len(name)) if name[j].startswith(w)), None)
                elif w in NUMERALS:
                    j = next((j for j in range(at, len(name)) if name[j] == NUMERALS[w]), None)
                else:
                    j = next((j for j in range(at, len(name)) if name[j] == w), None)
                read.append(w if j is None else name[j])
                at = at if j is None else j + 1
            out.add(" ".join(read))
        return out


def variants(value: str, names: Names) -> set[str]:
    """Readings of a typed value as plain words."""
    text = _GENDER.sub("", plain(value))
    text = _INITIALS.sub(lambda m: m.group().replace(".", ""), text)
    parts = [p for p in _SEPARATOR.split(text) if tidy(p)]
    texts = {text, *parts}
    if len(parts) == 2:
        texts.add(f"{parts[1]} {parts[0]}")
    return {v for t in texts for v in names.readings(re.findall(r"[^\W_]+(?:-?\.)?", t)) if v}


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 where it is above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def allowed(word: str) -> int:
    n = len(word)
    return 0 if n <= 3 else 1 if n <= 4 else 2 if n <= 6 else 3


def agreement(typed: str, name: str, short: bool) -> float | None:
    """Penalty of reading ``typed`` as ``name`` (0 the best), or None. ``short`` names are initials.

    Every word of the name must be met, in order, by a typed word with few edits, wherever that stands; of
    all ways to do so the cheapest counts. Words of the typed value beyond them cost a little, so the
    closest entry wins.
    """
    words, wanted = typed.split(), name.split()
    if short:
        best = min((edits(w, name, 1) for w in words), default=9)
        return None if best > 1 or len(name) < 3 else best + 0.3 * (len(words) - 1)
    far = float("inf")
    row = [0.0] * (len(words) + 1)  # the cheapest way to meet the words of the name so far in the first k typed ones
    for w in wanted:
        most, new = allowed(w), [row[0] + 0.5 if w in FILLERS else far]
        for k, t in enumerate(words):
            d = edits(t, w, most)
            new.append(min(new[-1], row[k] + d if d <= most else far, row[k + 1] + 0.5 if w in FILLERS else far))
        row = new
    if row[-1] < far:
        extra = [w for w in words if w not in FILLERS]
        spare = max(0, len(extra) - len([w for w in wanted if w not in FILLERS]))
        if row[-1] <= max(3, len(name) / 5):
            return row[-1] + 0.6 * spare
    joined, target = "".join(words), "".join(wanted)
    most = max(1, min(4, len(target) // 6))
    d = edits(joined, target, most)
    return d + 0.5 if d <= most and len(target) >= 6 else None


def grams(text):
    """Distinct padded 3-grams of the words of a plain text."""
    word = F.transform(F.split(text, " "), lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    each = F.transform(word, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def set_similarity_join(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (l, r) of (id, part, grams) tables with Jaccard similarity of at least num / den, within a part.

    Each side is posted under the rare grams of its prefix only; a pair must also pass the length filter
    and the positional filter before its sets are compared.
    """
    both = left.select("part", F.explode("grams").alias("g")).union(right.select("part", F.explode("grams").alias("g")))
    rarity = both.groupBy("part", "g").agg(F.count("*").alias("df"))

    def posted(side: DataFrame, id_name: str) -> DataFrame:
        one = side.select("id", "part", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(rarity, ["part", "g"])
        order = Window.partitionBy("id").orderBy("df", "g")
        one = one.withColumn("pos", F.row_number().over(order) - 1)
        prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
        return one.where(F.col("pos") < prefix).select("part", "g", F.col("id").alias(id_name), F.col("n").alias(f"n{id_name}"), F.col("pos").alias(f"p{id_name}"))

    pairs = posted(left, "l").join(posted(right, "r"), ["part", "g"])
    pairs = pairs.where((F.col("nl") * num <= F.col("nr") * den) & (F.col("nr") * num <= F.col("nl") * den))
    still = 1 + F.least(F.col("nl") - F.col("pl") - 1, F.col("nr") - F.col("pr") - 1)
    pairs = pairs.groupBy("l", "r", "nl", "nr").agg(F.max(F.least("pl", "pr") + still).alias("most"))
    pairs = pairs.where(F.col("most") * (num + den) >= num * (F.col("nl") + F.col("nr")))
    sets = pairs.select("l", "r").join(left.select(F.col("id").alias("l"), F.col("grams").alias("gl")), "l")
    sets = sets.join(right.select(F.col("id").alias("r"), F.col("grams").alias("gr")), "r")
    shared = F.size(F.array_intersect("gl", "gr"))
    jaccard = shared / (F.size("gl") + F.size("gr") - shared)
    return sets.withColumn("jaccard", jaccard).where(F.col("jaccard") >= num / den).select("l", "r", "jaccard")


def names_of(canon: DataFrame) -> DataFrame:
    """(ref_id, campo, nome, curto): names and initials of the list."""
    ok = canon.where("ref_id IS NOT NULL AND campo IS NOT NULL")
    long = ok.where("nome IS NOT NULL").select("ref_id", "campo", "nome", F.lit(False).alias("curto"))
    return long.unionByName(ok.where("sigla IS NOT NULL").select("ref_id", "campo", F.col("sigla").alias("nome"), F.lit(True).alias("curto")))


def best_entries(values: DataFrame, canon: DataFrame) -> DataFrame:
    """(campo, valor, ref_id) of distinct (campo, valor) that have an entry."""
    names = names_of(canon)
    blocks = max(1, -(-names.count() // LIST_BLOCK))
    parts = []
    for b in range(blocks):
        block = names.where(F.pmod(F.xxhash64("campo", "nome"), F.lit(blocks)) == b) if blocks > 1 else names
        parts.append(_scored(values, block))
    scored = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct("custo", "falta", "ref_id"))
    return scored.groupBy("campo", "valor").agg(best.alias("b")).select("campo", "valor", "b.ref_id")


def _scored(values: DataFrame, names: DataFrame) -> DataFrame:
    listed = names.collect()
    entries = [(r.ref_id, r.campo, tidy(plain(r.nome)), r.curto) for r in listed]
    by_field: dict[str, list[str]] = defaultdict(list)
    for r in listed:
        if not r.curto:
            by_field[r.campo].append(plain(r.nome))
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(dict(by_field))

    def spelled(batches):
        names = {c: Names(ns) for c, ns in shared.value.items()}
        none = Names([])
        for pdf in batches:
            rows = [(c, v, x) for c, v in zip(pdf.campo, pdf.valor, strict=True) for x in variants(v, names.get(c, none))]
            yield pd.DataFrame(rows, columns=["campo", "valor", "variante"])

    typed = values.select("campo", "valor").mapInPandas(spelled, "campo string, valor string, variante string")
    typed = materialize(typed)
    left = typed.select("campo", "variante").distinct()
    left = left.select(F.struct("campo", "variante").alias("id"), F.col("campo").alias("part"), grams(F.col("variante")).alias("grams"))
    listed = spark.createDataFrame([e for e in entries if e[2]] or [(0, "", "", False)], "ref_id long, part string, nome string, curto boolean")
    right = listed.select(F.struct("ref_id", "nome", "curto").alias("id"), "part", grams(F.col("nome")).alias("grams"))
    pairs = materialize(set_similarity_join(left, right, NUM, DEN).select("l.*", "r.*", "jaccard"))

    def score(variante: pd.Series, nome: pd.Series, curto: pd.Series) -> pd.Series:
        return pd.Series([agreement(*x) for x in zip(variante, nome, curto, strict=True)], dtype=float)

    cost = F.pandas_udf(score, "double")("variante", "nome", "curto")
    kept = pairs.withColumn("custo", cost).where("custo IS NOT NULL AND NOT isnan(custo)")
    kept = kept.select("campo", "variante", "ref_id", "custo", (1 - F.col("jaccard")).alias("falta"))
    return typed.join(kept, ["campo", "variante"]).select("campo", "valor", "ref_id", "custo", "falta")


def typed_values(df: DataFrame, canon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of values to map: not null, not blank, not exactly a name of their list."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("campo"), F.col(f).alias("valor")) for f in FIELDS])).alias("p")
    rows = df.select(F.col("id").alias("questao_id"), pairs).select("p.campo", "questao_id", "p.valor")
    rows = rows.where(F.col("valor").rlike(r"[^\s\p{Z}]"))
    counts = rows.groupBy("campo", "valor").agg(F.count("*").alias("n"))
    names = canon.select("campo", F.col("nome").alias("valor")).distinct()
    return rows, materialize(counts.join(names, ["campo", "valor"], "left_anti"))


def mapped(df: DataFrame, canon: DataFrame) -> DataFrame:
    """(campo, questao_id, ref_id) of every value to map; 0 where the list has no entry.

    A value that fills a third of the table is never gathered in one task.
    """
    rows, counts = typed_values(df, canon)
    found = counts.join(best_entries(counts, canon), ["campo", "valor"], "left")
    found = materialize(found.select("campo", "valor", "n", F.coalesce("ref_id", F.lit(0)).cast("long").alias("ref_id")))
    return join_counted(rows, found, ["campo", "valor"], "n").select("campo", "questao_id", "ref_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every freely typed value with its entry, or 0."""
    return mapped(table(spark, sf_dir, "questoes"), table(spark, sf_dir, "lista_canonica"))


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct values without an entry, and how many questions have each."""
    canon = table(spark, sf_dir, "lista_canonica")
    _, counts = typed_values(table(spark, sf_dir, "questoes"), canon)
    return counts.join(best_entries(counts, canon), ["campo", "valor"], "left_anti").select("campo", "valor", F.col("n").alias("n_questoes"))


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
SQL: dict[str, str] = {}
