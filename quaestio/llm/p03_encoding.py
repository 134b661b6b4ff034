"""Problem 3: text decoded with the wrong encoding.

A multinomial classifier over hashed byte bigrams is trained on words of clean records and on the same
words put through every encoding chain (once, twice, or with letters lost). For each suspicious word it
scores every chain; the words of one value add their evidence. Chains likelier than a clean word are
tried from the likeliest on: the first that inverts is taken, under strict decodability, where each step
must encode and decode without error, and the result must look clean to the classifier. Words with lost
letters are a class of their own, of the same classifier. Chains between single-byte encodings always decode, and lost
letters leave only a pattern; their words must further be words of the corpus itself.

The classifier is fitted on at most ``TRAIN_VALUES`` values (those of smallest hashed id); everything
else runs over all values. Defined cases: null, empty and plain ASCII values are clean; a value may be
garbled in part; equal values get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.llm.texts import OPTION, STEM, fields
from quaestio.session import materialize, spread

TRAIN_VALUES = 6000
BUCKETS = 1 << 13
WORD_RATE = 1e-6  # share of all words from which on, and more than once, a word is one of the corpus
LOST = "�"
#: Fixed value: the letters of Portuguese beyond ASCII.
LETTERS = "áàâãäéêíóôõöúüçñÁÀÂÃÉÊÍÓÔÕÚÜÇÑ"
#: Fixed value: the chains, as (encoding written, encoding read) pairs.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>mac": (("utf-8", "mac-roman"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "latin1>cp850": (("latin-1", "cp850"),),
    "latin1>cp437": (("latin-1", "cp437"),),
    "latin1>mac": (("latin-1", "mac-roman"),),
    "mac>latin1": (("mac-roman", "cp1252"),),
    "cp850>latin1": (("cp850", "cp1252"),),
    "utf8>latin1 x2": (("utf-8", "latin-1"),) * 2,
    "utf8>cp1252 x2": (("utf-8", "cp1252"),) * 2,
    "utf8>cp1252, utf8>latin1": (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    "utf8>latin1, utf8>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    "utf8>cp850 x2": (("utf-8", "cp850"),) * 2,
    "utf8>mac x2": (("utf-8", "mac-roman"),) * 2,
    "utf8>cp1252, latin1>cp850": (("utf-8", "cp1252"), ("latin-1", "cp850")),
}
NAMES = ["clean", *CHAINS, "lost"]
_TOKEN = re.compile(r"[^ \t\r\n]+")
_MARKED = re.compile(r"[^\W\d_]\?+[^\W\d_]")
_ACCENTED = re.compile(r"(?=[^\W\d_]{2})[^\W\d_]*[^\W\d_\x00-\x7F]")  # a word of two letters at least, one of them accented


@lru_cache(maxsize=None)
def _reader(encoding: str) -> tuple[str, dict[str, int]]:
    """All 256 characters of a single-byte encoding (unassigned bytes read as control codes), and its inverse."""
    chars = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in enumerate(chars)}


def garble(text: str, chain: str) -> str | None:
    for write, read in CHAINS[chain]:
        try:
            raw = text.encode(write)
        except UnicodeEncodeError:
            return None
        chars = _reader(read)[0]
        text = "".join(chars[b] for b in raw)
    return text


def invert(text: str, chain: str) -> str | None:
    """The original of a garbled text, or None where any step does not decode strictly."""
    for write, read in reversed(CHAINS[chain]):
        back = _reader(read)[1]
        try:
            raw = bytes([back[c] for c in text])
            text = raw.decode(write)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def _bigrams(word: str) -> np.ndarray:
    raw = np.frombuffer(b"\x02" + word.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.int64)
    return ((raw[:-1] << 8 | raw[1:]) * 40503 >> 3) % BUCKETS


def _looks_decodable(word: str) -> bool:
    return any(len(c) == 1 and c[0][0] == "utf-8" and invert(word, n) is not None for n, c in CHAINS.items())


def train(values: list[str]) -> np.ndarray:
    """Log probabilities (class, bucket), smoothed, of byte bigrams of the non-ASCII words of ``values``."""
    counts = np.full((len(NAMES), BUCKETS), 0.05)
    words: dict[str, int] = {}
    for v in values:
        for t in _TOKEN.findall(v):
            if not t.isascii() and LOST not in t:
                words[t] = words.get(t, 0) + 1
    for w, n in words.items():
        if _looks_decodable(w):
            continue
        weight = min(n, 20)
        np.add.at(counts[0], _bigrams(w), weight)
        for k, name in enumerate(CHAINS, 1):
            g = garble(w, name)
            if g is not None and g != w:
                np.add.at(counts[k], _bigrams(g), weight)
        for mark in (LOST, LOST * 2, "?"):
            np.add.at(counts[-1], _bigrams("".join(c if c.isascii() else mark for c in w)), weight)
        for k in [k for k, c in enumerate(w) if not c.isascii()] if sum(not c.isascii() for c in w) > 1 else ():  # lost in part
            for mark in (LOST, "?"):
                np.add.at(counts[-1], _bigrams(w[:k] + mark + w[k + 1 :]), weight)
    return np.log(counts / counts.sum(1, keepdims=True))


class Detector:
    def __init__(self, model: np.ndarray):
        self.model = model
        self.cache: dict[str, np.ndarray] = {}

    def scores(self, word: str) -> np.ndarray:
        s = self.cache.get(word)
        if s is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            s = self.cache[word] = self.model[:, _bigrams(word)].sum(1)
        return s

    def clean(self, word: str) -> bool:
        return word.isascii() or int(self.scores(word).argmax()) == 0

    def restore(self, token: str, order: list[int]) -> tuple[str, str, bool] | None:
        """(chain, original, sure) by the first chain, in the order given, that inverts strictly to clean text."""
        for k in order:
            name = NAMES[k]
            if name in ("clean", "lost"):
                continue
            text = invert(token, name)
            if text is None or text == token or any(ord(c) < 32 or 127 <= ord(c) < 160 for c in text):
                continue
            if not self.clean(text):
                continue
            name = next(n for n in CHAINS if invert(token, n) == text)  # of equal inverses the simplest
            if all(write == "utf-8" for write, _ in CHAINS[name]):
                return name, text, True
            if any(c in LETTERS for c in text) and all(c.isascii() or c in LETTERS or not c.isalpha() for c in text):
                return name, text, False
        return None

    def spans(self, text: str) -> list[tuple[int, int, str, str, bool]]:
        """(start, end, chain, original, sure) of the garbled words of a value.

        Where letters are lost, the original is a pattern with '?' for each lost letter.
        """
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text) if not m.group().isascii() or "?" in m.group()]
        odd = [(s, e, t, self.scores(t)) for s, e, t in tokens if not t.isascii() and LOST not in t and self.scores(t).argmax()]
        out = []
        if odd:
            whole = np.sum([x[3] for x in odd], 0)
            for s, e, t, own in odd:
                order = sorted(np.flatnonzero(own > own[0]), key=lambda k: -(own[k] + whole[k]))
                if found := self.restore(t, order):
                    out.append((s, e, *found))
        for s, e, t in tokens:
            own = self.scores(t) if LOST in t or _MARKED.search(t) else None
            if own is not None and own[-1] > own[0]:
                out.append((s, e, "lost", t.replace(LOST, "?"), LOST in t))
        return sorted(out)


SPAN = pa.struct([("inicio", pa.int32()), ("fim", pa.int32()), ("cadeia", pa.string()), ("original", pa.string()), ("certo", pa.bool_()), ("isolado", pa.bool_())])
_DDL = "campo string, registro_id long, texto string, trechos array<struct<inicio:int,fim:int,cadeia:string,original:string,certo:boolean,isolado:boolean>>"


def _span(text, start, end, chain, original, sure) -> dict:
    lone = not sure and chain != "lost" and not _ACCENTED.search(original)
    return {"inicio": start, "fim": end, "cadeia": chain, "original": original, "certo": sure, "isolado": lone}


def _detect(model):
    def run(batches):
        detector = Detector(model.value)
        for batch in batches:
            rows = []
            for campo, rid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if spans := detector.spans(text):
                    rows.append((campo, rid, text, [_span(text, *s) for s in spans]))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(SPAN))],
                names=["campo", "registro_id", "texto", "trechos"],
            )

    return run


def model_of(values: DataFrame) -> np.ndarray:
    """The classifier, fitted on TRAIN_VALUES values by hashed id. One hash class of about four times as
    many is ordered, so what the tasks send back is bounded as well."""
    h = F.xxhash64("campo", "registro_id")
    classes = max(1, values.count() // (4 * TRAIN_VALUES))
    sample = values.where((F.pmod(h, F.lit(classes)) == 0) & F.col("texto").rlike(r"[^\x00-\x7F]")).orderBy(h, "registro_id").limit(TRAIN_VALUES)
    return train([r.texto for r in sample.select("texto").collect()])


def suspicious_spans(values: DataFrame, corpus: DataFrame) -> DataFrame:
    """(campo, registro_id, texto, trechos) of values with a word that a chain, strictly inverted, explains."""
    spark = values.sparkSession
    model = spark.sparkContext.broadcast(model_of(corpus))
    may = values.where(F.col("texto").rlike(r"[^\x00-\x7F]|\p{L}\?+\p{L}"))
    return spread(may).mapInArrow(_detect(model), _DDL)


def pattern(word):
    return F.regexp_replace(word, r"[^\x00-\x7F]", "?")


def corpus_words(values: DataFrame) -> DataFrame:
    """(chave, palavra): words of the corpus with accented letters, by themselves and by their pattern; the most frequent of each."""
    word = F.explode(F.regexp_extract_all(F.lower("texto"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("palavra")
    every = F.sum(F.size(F.regexp_extract_all(F.lower("texto"), F.lit(r"(\p{L}+)"), F.lit(1))))
    total = values.agg(every).first()[0] or 0
    counts = values.select(word).where(f"palavra rlike '^[a-z{LETTERS}]+$' AND palavra rlike '[^\\\\x00-\\\\x7F]'").groupBy("palavra").count()
    counts = counts.where((F.col("count") > 1) & (F.col("count") >= WORD_RATE * total))
    keyed = counts.select("palavra", "count", F.explode(F.array_distinct(F.array("palavra", pattern(F.col("palavra"))))).alias("chave"))
    return keyed.groupBy("chave").agg(F.max_by("palavra", F.struct("count", "palavra")).alias("palavra"))


def verified_spans(values: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Of ``values``, tested with the classifier and words of ``corpus`` (by default the same values): one row for each accepted garbled word: (campo, registro_id, inicio, fim, cadeia, original).

    Sure words stand; of others every accented or incomplete word must be one of the corpus.
    """
    corpus = values if corpus is None else corpus
    spans = materialize(suspicious_spans(values, corpus))
    s = spans.select("campo", "registro_id", F.posexplode("trechos").alias("k", "t")).select("campo", "registro_id", "k", "t.*")
    parts = F.filter(F.regexp_extract_all(F.lower("original"), F.lit(r"([\p{L}?]*[\p{L}][\p{L}?]*)"), F.lit(1)), lambda w: w.rlike(r"[^\x00-\x7F]|\?"))
    word = s.withColumn("parte", F.explode_outer(F.when(F.size(parts) > 0, parts)))
    # a word may keep some of its accented letters: it is looked up without any, and must agree with those
    word = word.withColumn("chave", F.when(F.contains("parte", F.lit("?")), pattern(F.col("parte"))).otherwise(F.col("parte")))
    known = word.join(corpus_words(corpus), "chave", "left")
    agrees = F.rlike("palavra", F.concat(F.lit("^"), F.replace("parte", F.lit("?"), F.lit(".")), F.lit("$")))
    known = known.withColumn("palavra", F.when(agrees, F.col("palavra")))
    agg = known.groupBy("campo", "registro_id", "k").agg(
        F.first("inicio").alias("inicio"), F.first("fim").alias("fim"), F.first("cadeia").alias("cadeia"),
        F.first("original").alias("original"), F.first("certo").alias("certo"), F.first("isolado").alias("isolado"),
        F.count("parte").alias("n"), F.count("palavra").alias("conhecidas"),
        F.map_from_entries(F.filter(F.collect_set(F.struct("parte", "palavra")), lambda x: x["palavra"].isNotNull() & x["parte"].contains("?"))).alias("lidas"),
    )
    found = agg.where("certo OR (n > 0 AND n = conhecidas)")
    # a lone symbol, such as a Greek letter in a formula, needs a word garbled by the same chain beside it
    beside = F.max((F.col("certo") | ~F.col("isolado")).cast("int")).over(Window.partitionBy("campo", "registro_id", "cadeia"))
    return found.withColumn("ao_lado", beside).where("ao_lado = 1").drop("certo", "n", "conhecidas", "k", "isolado", "ao_lado")


def garbled(values: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(campo, registro_id) of garbled values."""
    return verified_spans(values, corpus).select("campo", "registro_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were decoded wrongly, in whole or in part."""
    return garbled(fields(spark, sf_dir, STEM, OPTION))


def _rebuild(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, found):
        for s in sorted(found, key=lambda s: -s["inicio"]):
            new = s["original"]
            if s["cadeia"] == "lost":
                read = {e["key"]: e["value"] for e in s["lidas"]}
                new = re.sub(r"[^\W\d_?]*\?[\w?]*|\w+\?\w+", lambda m: _as_case(m.group(), read.get(m.group().lower())), new)
                if "?" in new and LOST in t[s["inicio"] : s["fim"]]:
                    new = t[s["inicio"] : s["fim"]]
            t = t[: s["inicio"]] + new + t[s["fim"] :]
        return t

    return text.combine(spans, one)


def _as_case(seen: str, word: str | None) -> str:
    if word is None:
        return seen
    return word.upper() if seen.isupper() and len(seen.replace("?", "")) > 1 else word.capitalize() if seen[:1].isupper() else word


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled value with its chains and the text restored; lost letters without a known word stay as they are."""
    values = fields(spark, sf_dir, STEM, OPTION)
    spans = verified_spans(values).groupBy("campo", "registro_id").agg(
        F.array_sort(F.collect_set("cadeia")).alias("cadeias"),
        F.array_sort(F.collect_list(F.struct("inicio", "fim", "cadeia", "original", F.map_entries("lidas").alias("lidas")))).alias("trechos"),
    )
    out = values.join(spans, ["campo", "registro_id"])
    return out.select("campo", "registro_id", F.array_join("cadeias", "; ").alias("cadeias"), F.pandas_udf(_rebuild, "string")("texto", "trechos").alias("texto_restaurado"))


QUERIES = {"p3_found": p3_found, "p3_restored": p3_restored}
SQL: dict[str, str] = {}
