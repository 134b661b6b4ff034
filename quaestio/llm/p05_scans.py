"""Problem 5: noise in text from scanned pages.

Words: the vocabulary is counted over all stems and support texts, without the halves of words split at
line ends. Suspicious words mix letters and digits, or become a far more frequent word when a pair of
letters is read as another. For each distinct suspicious word all vocabulary words within a bounded
number of edits are retrieved: a Levenshtein automaton, extended by merges and splits such as rn for m,
is run against a trie of the vocabulary, in shards of one word length each. Candidates that only the
confusions of scanning explain are kept; several are ranked by their neighbours in the text.

Page furniture (headers, footers, page numbers) is recognized amid the text and removed; words split at
line ends are joined where the whole is a word; wrapped lines are then reflowed into paragraphs.

Defined cases: null values are left out; blank ones stay as they are; lists, verse and codes are kept;
equal values get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.llm.texts import STEM, SUPPORT, fields
from quaestio.session import materialize, spread

VOCABULARY_RATE, MIN_COUNT = 3e-6, 3  # share of all words from which on a word is one of the vocabulary; the least occurrences that say anything
RATIO = 20  # how many times more frequent the reading of a word without digits must be
LIMIT, OTHER = 3.1, 1.37  # greatest cost of a candidate; cost of an edit that is no confusion of scanning (those cost 1)
SHARD_WORDS = 100_000
PART_TOKENS = 5_000
#: What scanning confuses, as seen and as meant.
DIGITS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"}
PAIRS = {"rn": "m", "nn": "m", "cl": "d", "vv": "w", "ii": "u", "m": "rn", "d": "cl"}
MERGES = {k: v for k, v in PAIRS.items() if len(k) == 2}
SPLITS = {k: v for k, v in PAIRS.items() if len(k) == 1}

_HYPHEN = "[-‐‑¬­]"
SPLIT = re.compile(rf"([^\W_]+){_HYPHEN}[ \t]*\r?\n[ \t]*([^\W_]+)")
_SPLIT_SQL = r"[\p{L}\p{N}]+[-‐‑¬­][ \t]*\r?\n[ \t]*[\p{L}\p{N}]+"
_UP = r"[A-ZÀ-ÖØ-Þ]"
_HEAD = rf"{_UP}{{2,}}(?:[ \-]+(?:{_UP}+\b))+"
_PAGE = r"(?:P[áa]gina|P[áa]g\.|P[áa]g|pg\.?|[Ff]ls?\.|Folha)"
#: The forms of page furniture.
_LINE = (
    r"[-–—]\s*\d{1,4}\s*[-–—]",
    r"[\[(]?\d{1,4}[\])]?",
    r"\d{1,4}\s*/\s*\d{1,4}",
    rf"{_PAGE}\s*\d{{1,4}}(?:\s*(?:de|/)\s*\d{{1,4}})?",
)
_INLINE = (
    rf"\b{_PAGE}\s*\d{{1,4}}\s*(?:de|/)\s*\d{{1,4}}\b",
    rf"(?:{_UP}[\w\-]*(?: (?:d[aeo]s?|em|e|[IVX]+|{_UP}[\w\-]*))* [–-] )?\bTipo \d+ [–-] {_PAGE}\s*\d{{1,4}}\b",
    rf"\b(?:Concurso|Processo Seletivo|Edital)\s+(?:n[.º°o]*\s*)?\d+/\d{{4}}\s*[–-]\s*{_PAGE}\s*\d{{1,4}}\b",
    r"\bEdital n\.?[º°] ?\d+/\d{4} \.{3} [^\n.]{3,40} \.{3} \d{1,4}/\d{1,4}\b",
    r"\bProva \d+ \(cor [^\W\d_]+\)",
    rf"\b{_UP}+(?:[ ]+{_UP}+)*[ ]*\|[ ]*TIPO \d+(?:[ ]*\|[ ]*{_UP}+)?(?:[ ]+\d{{1,4}})?\b",
    r"\bN[ÃA]O É PERMITIDA A REPRODUÇÃO[A-ZÀ-Þ ]*(?:\n\s*\d{1,4}(?=\n))?",
    rf"\b{_HEAD}[ ]+[–-][ ]+CONCURSO PÚBLICO \d{{4}}\b",
    rf"\b{_HEAD}[ ]+[–-][ ]+(?:MANHÃ|TARDE|NOITE)[ ]+{_PAGE}\s*\d{{1,4}}\b",
    rf"\b{_HEAD}[ ]{{1,12}}\d{{1,4}}(?=\s+(?:[^\W\dA-ZÀ-Þ_]|\d|$))(?![ ]*/)",
    r"\b\d{1,4}[ ]\|[ ]+(?:[\d-]{1,12}[ ])?[^\n|]{3,28}? (?:de|da|do|das|dos)(?: [A-ZÀ-Þ][\w-]*(?: (?:d[aeo]s?|[A-ZÀ-Þ])[\w-]*){0,4})",
    r"(?m:^[ \t]*\d{1,4}[ ]\|[^\n]{3,60}$)",
)
LINE = re.compile(rf"^[ \t]*(?:{'|'.join(_LINE)})[ \t]*$")
INLINE = re.compile("|".join(_INLINE))
#: What a value with furniture or a split word must hold, for the JVM: each form above without its bounds.
_Z = r"[\s\p{Z}]*"
_MAYBE = "|".join((
    r"[\p{L}\p{N}][-‐‑¬\u00AD][ \t]*\r?\n[ \t]*[\p{L}\p{N}]",
    rf"(?m:^[ \t]*(?:[-–—]{_Z}\d{{1,4}}{_Z}[-–—]|[\[(]?\d{{1,4}}[\])]?|\d{{1,4}}{_Z}/{_Z}\d{{1,4}})[ \t]*$)",
    rf"(?:P[áa]gina|P[áa]g\.?|pg\.?|[Ff]ls?\.|Folha){_Z}\d",
    r"Edital n|Prova \d+ \(cor|\|[ ]*TIPO \d|REPRODUÇÃO|CONCURSO PÚBLICO \d|\d[ ]\|",
    rf"{_UP}{{2,}}(?:[ \-]+{_UP}+)+[ ]{{1,12}}\d",
))


def furniture(text: str) -> list[tuple[int, int]]:
    """(start, end) of page furniture amid a text: something of the text stands before and after it.

    In a text that is mostly in capitals itself, only whole lines are told from it.
    """
    loud = sum(c.isupper() for c in text) > 0.5 * sum(c.isalpha() for c in text)
    found = [] if loud else [m.span() for m in INLINE.finditer(text)]
    at = 0
    for line in text.split("\n"):
        if (LINE.match(line) or loud and INLINE.fullmatch(line.strip())) and all(at + len(line) <= s or at >= e for s, e in found):
            found.append((at, at + len(line)))
        at += len(line) + 1
    found.sort()
    first = re.compile(r"[^\W_]").search(text)
    return [(s, e) for s, e in found if first and first.start() < s and re.search(r"[^\W_]", text[e:])]


def split_words(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, left, right) of words with a hyphen at a line end; a capital after it is no half of a word."""
    return [(m.start(), m.end(), m[1], m[2]) for m in SPLIT.finditer(text) if not (m[2][0].isupper() and not m[1].isupper())]


# ---- vocabulary, suspects and their readings


def token_counts(values: DataFrame) -> DataFrame:
    """(palavra, n) of all words in lower case, without the halves of words split at line ends."""
    whole = F.lower(F.regexp_replace("texto", _SPLIT_SQL, " "))
    words = values.select(F.explode(F.regexp_extract_all(whole, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("palavra"))
    return words.groupBy("palavra").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """The words of letters that are frequent enough by their share, so that misread ones don't become words as a bank grows."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("palavra").rlike(r"^\p{L}+$") & (F.col("n") >= max(MIN_COUNT, VOCABULARY_RATE * total)))


def is_mixed(word: Column) -> Column:
    return word.rlike(r"\p{N}") & word.rlike(r"\p{L}.*\p{L}") & ~word.rlike(r"^\d+\p{L}{1,3}$") & ~word.rlike(r"^\p{N}+[ªº]")


def suspects(counts: DataFrame, vocab: DataFrame, split: DataFrame) -> DataFrame:
    """(palavra, n) of suspicious words: mixed ones, joined halves that are no words, and letters read as others."""
    mixed = counts.where(is_mixed(F.col("palavra")))
    joined = split.select(F.lower(F.col("junta")).alias("palavra")).distinct().join(vocab, "palavra", "left_anti")
    joined = joined.where(is_mixed(F.col("palavra")) | F.col("palavra").rlike("|".join(MERGES))).withColumn("n", F.lit(1).cast("long"))
    plain = counts.where(F.col("palavra").rlike(r"^\p{L}{3,}$"))
    read = F.array(*[F.replace(F.col("palavra"), F.lit(a), F.lit(b)) for a, b in PAIRS.items()])
    other = plain.select("palavra", "n", F.explode(F.array_distinct(read)).alias("outra")).where("outra <> palavra")
    better = vocab.select(F.col("palavra").alias("outra"), F.col("n").alias("m"))
    letters = other.join(better, "outra").where(F.col("m") >= RATIO * F.col("n")).select("palavra", "n")
    return mixed.unionByName(joined).unionByName(letters).groupBy("palavra").agg(F.max("n").alias("n"))


class Trie:
    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, seen: str, limit: float) -> list[tuple[str, float]]:
        """All words whose cost of being read as ``seen`` is at most ``limit``: the automaton's states are
        rows of costs, one for each length of ``seen``, and a branch ends where no state is alive."""
        n = len(seen)
        start = [OTHER * j for j in range(n + 1)]
        out = []
        stack = [(self.root, "", None, start)]
        while stack:
            node, last, before, row = stack.pop()
            if "" in node and row[n] <= limit:
                out.append((node[""], row[n]))
            for c, child in node.items():
                if c == "":
                    continue
                new = [row[0] + OTHER]
                for j in range(1, n + 1):
                    s = seen[j - 1]
                    cost = 0 if s == c else 1 if c in DIGITS.get(s, "") else OTHER
                    best = min(row[j - 1] + cost, row[j] + OTHER, new[j - 1] + OTHER)
                    if j > 1 and MERGES.get(seen[j - 2 : j]) == c:
                        best = min(best, row[j - 2] + 1)
                    if before is not None and SPLITS.get(s) == last + c:
                        best = min(best, before[j - 1] + 1)
                    new.append(best)
                if min(new) <= limit:
                    stack.append((child, c, row, new))
        return out


def readings(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """(palavra, lida, custo, m): every vocabulary word that scanning may have turned into a suspicious word."""
    found, vocab = materialize(found), materialize(vocab)
    shards = max(1, -(-vocab.count() // SHARD_WORDS))
    parts = max(8, -(-found.count() // PART_TOKENS))  # a group holds PART_TOKENS suspicious and SHARD_WORDS listed words at most
    # each confusion changes the length by one at most
    lengths = F.explode(F.sequence(F.greatest(F.lit(1), F.length("palavra") - 3), F.length("palavra") + 3))
    left = found.withColumn("tam", lengths).withColumn("fatia", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = left.withColumn("parte", F.pmod(F.xxhash64("palavra"), F.lit(parts)))
    right = vocab.select(F.col("palavra").alias("lida"), F.col("n").alias("m"), F.length("palavra").alias("tam"))
    right = right.withColumn("fatia", F.pmod(F.xxhash64("lida"), F.lit(shards))).withColumn("parte", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = [F.col("tam"), F.col("fatia").cast("long"), F.col("parte").cast("long")]

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            trie, counts = Trie(b.lida), dict(zip(b.lida, b.m, strict=True))
            for w in a.palavra:
                k = sum(c.isdigit() for c in w) + sum(p in w for p in PAIRS)
                rows += [(w, x, c, counts[x]) for x, c in trie.within(w, min(LIMIT, k + 0.1)) if c > 0]
        return pd.DataFrame(rows, columns=["palavra", "lida", "custo", "m"])

    names = ["tam", "fatia", "parte"]
    left, right = (df.select(*[k.alias(x) for k, x in zip(keys, names, strict=True)], *[c for c in df.columns if c not in names]) for df in (left, right))
    # few bytes but much work: a number of partitions that isn't coalesced by size
    tasks = 2 * found.sparkSession.sparkContext.defaultParallelism
    left, right = left.repartition(tasks, *names), right.repartition(tasks, *names)
    pairs = left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(match, "palavra string, lida string, custo double, m long")
    # confusions only: such costs are whole numbers; words without digits need a far more frequent reading
    pairs = pairs.where(F.abs(F.col("custo") - F.round("custo")) < 1e-9).join(found, "palavra")
    return pairs.where(F.col("palavra").rlike(r"\p{N}") | (F.col("m") >= RATIO * F.col("n"))).select("palavra", "lida", "custo", "m")


# ---- values


def pages(values: DataFrame) -> DataFrame:
    """(campo, registro_id, mobilia, partidas): furniture flag and words split at line ends, of values that may have any."""

    def run(batches):
        for batch in batches:
            flags, splits = [], []
            for t in batch.column(2).to_pylist():
                flags.append(bool(furniture(t)))
                splits.append([{"junta": a + b, "esquerda": a, "direita": b} for _, _, a, b in split_words(t)])
            kind = pa.list_(pa.struct([("junta", pa.string()), ("esquerda", pa.string()), ("direita", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.bool_()), pa.array(splits, kind)], names=["campo", "registro_id", "mobilia", "partidas"])

    may = spread(values.where(F.col("texto").rlike(_MAYBE)))
    return may.mapInArrow(run, "campo string, registro_id long, mobilia boolean, partidas array<struct<junta:string,esquerda:string,direita:string>>")


def noise(values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, joins, candidates): found (campo, registro_id); joins (junta) that are words; candidates as ``readings``."""
    page = materialize(pages(values))
    split = page.select("campo", "registro_id", F.explode("partidas").alias("p")).select("campo", "registro_id", "p.*")
    counts = materialize(token_counts(values))
    vocab = vocabulary(counts)
    candidates = materialize(readings(suspects(counts, vocab, split), vocab))
    bad = candidates.select("palavra").distinct()
    joins = split.select(F.lower(F.col("junta")).alias("palavra")).distinct().join(vocab.select("palavra").unionByName(bad).distinct(), "palavra", "left_semi")
    joins = materialize(joins)
    cut = split.join(joins.withColumnRenamed("palavra", "j"), F.lower(F.col("junta")) == F.col("j")).select("campo", "registro_id")
    # a short word at the very end may be the beginning of a cut one, such as cla for classe
    whole = F.regexp_replace(F.lower("texto"), r"(?<![\p{L}\p{N}])\p{L}{1,4}$", "")
    words = F.array_distinct(F.regexp_extract_all(whole, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    odd = F.filter(words, lambda w: (F.length(w) > 1) & w.rlike(r"\p{N}|" + "|".join(PAIRS)) & w.rlike(r"\p{L}"))
    read = values.select("campo", "registro_id", F.explode(odd).alias("palavra")).join(bad, "palavra").select("campo", "registro_id")
    found = page.where("mobilia").select("campo", "registro_id").unionByName(cut).unionByName(read).distinct()
    return found, joins, candidates


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with a split word, a misread word or page furniture."""
    return noise(fields(spark, sf_dir, STEM, SUPPORT))[0]


def ranked(values: DataFrame, noisy: DataFrame, candidates: DataFrame) -> DataFrame:
    """(campo, registro_id, palavra, lida): for each noisy value and misread word the reading its neighbours make likeliest.

    Cost first; of equal cost the reading more often seen beside the neighbours in all values, then the
    more frequent. Only words with several such readings look at neighbours.
    """
    best = candidates.join(candidates.groupBy("palavra").agg(F.min("custo").alias("custo")), ["palavra", "custo"])
    best = materialize(best.withColumn("varias", F.count("*").over(Window.partitionBy("palavra")) > 1))
    text = F.lower(F.regexp_replace("texto", r"[-‐‑¬­][ \t]*\r?\n[ \t]*", ""))
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    w = noisy.select("campo", "registro_id", words.alias("w"))
    places = w.select("campo", "registro_id", F.posexplode("w").alias("k", "palavra"), "w")
    near = places.join(best, "palavra").select(
        "campo", "registro_id", "palavra", "lida", "m", "varias", F.get("w", F.col("k") - 1).alias("antes"), F.get("w", F.col("k") + 1).alias("depois")
    )
    near = materialize(near)
    doubt = near.where("varias")
    needed = doubt.select(F.col("antes").alias("a"), F.col("lida").alias("b")).union(doubt.select("lida", "depois")).distinct()
    each = values.select(words.alias("w")).where("size(w) > 1")
    both = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    pairs = each.select(F.explode(both).alias("p")).select("p.*").where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = materialize(pairs.join(needed, ["a", "b"]))
    left = pairs.select(F.col("a").alias("antes"), F.col("b").alias("lida"), F.col("n").alias("na"))
    right = pairs.select(F.col("a").alias("lida"), F.col("b").alias("depois"), F.col("n").alias("nd"))
    scored = near.join(left, ["antes", "lida"], "left").join(right, ["lida", "depois"], "left")
    score = F.struct((F.log1p(F.coalesce("na", F.lit(0))) + F.log1p(F.coalesce("nd", F.lit(0)))).alias("s"), "m", "lida")
    return scored.groupBy("campo", "registro_id", "palavra").agg(F.max_by("lida", score).alias("lida"))


def repaired(text: str, words: dict[str, str], joins: set[str]) -> str:
    """A text without furniture, with its words joined and read right, and its wrapped lines reflowed."""
    out, at = [], 0
    for s, e in furniture(text):
        out.append(text[at:s].rstrip(" \t") if text[s - 1 : s] == "\n" else text[at:s])
        at = e + 1 if text[s - 1 : s] == "\n" and text[e : e + 1] == "\n" else e
    text = re.sub(r"(?<=\S) {2,}(?=[^\W_])", " ", "".join([*out, text[at:]])) if out else text
    text = SPLIT.sub(lambda m: m[1] + m[2] if (m[1] + m[2]).lower() in joins else m.group(), text)

    def read(m):
        w = m.group()
        new = words.get(w.lower())
        return w if new is None else new.upper() if w.isupper() and len(w) > 1 else new.capitalize() if w[0].isupper() else new

    text = re.sub(r"[^\W_]+", read, text)
    lines = [re.sub(r"[ \t]+$", "", x) for x in text.split("\n")]
    flowed: list[str] = []
    for x in lines:
        goes_on = bool(flowed) and flowed[-1] and x.strip() and re.match(r"\s*[a-zß-ÿ(“\"\d]", x) and not re.search(r"[.:;!?,]$", flowed[-1])
        if goes_on:
            flowed[-1] += " " + x.strip()
        else:
            flowed.append(x)
    return "\n".join(flowed)


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each noisy value as continuous text."""
    values = fields(spark, sf_dir, STEM, SUPPORT)
    found, joins, candidates = noise(values)
    noisy = materialize(values.join(found, ["campo", "registro_id"]))
    lists = ranked(values, noisy, candidates).groupBy("campo", "registro_id").agg(F.map_from_entries(F.collect_list(F.struct("palavra", "lida"))).alias("lidas"))
    halves = noisy.select("campo", "registro_id", F.explode(F.regexp_extract_all("texto", F.lit(_SPLIT_SQL), F.lit(0))).alias("s"))
    whole = F.lower(F.regexp_replace("s", r"[-‐‑¬­][ \t]*\r?\n[ \t]*", "")).alias("palavra")
    halves = halves.select("campo", "registro_id", whole).join(joins, "palavra").groupBy("campo", "registro_id").agg(F.collect_set("palavra").alias("juntas"))
    rows = noisy.join(lists, ["campo", "registro_id"], "left").join(halves, ["campo", "registro_id"], "left")

    def mend(text: pd.Series, words: pd.Series, joins: pd.Series) -> pd.Series:
        both = ({} if w is None else {e["key"]: e["value"] for e in w} for w in words)
        return pd.Series([repaired(t, w, set() if j is None else set(j)) for t, w, j in zip(text, both, joins, strict=True)], dtype=object)

    udf = F.pandas_udf(mend, "string")
    return rows.select("campo", "registro_id", udf("texto", F.map_entries("lidas"), "juntas").alias("texto_reparado"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
