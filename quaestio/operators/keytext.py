"""Answers read from the lines of key documents.

Every reader takes lines (doc, n, linha), with n the order in the document, and gives observations
(doc, numero, resposta); conflicts are settled by ``linkage.merge_observations``. A document's lines
meet only in windows over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR = r"\b0*[1-9]\d{0,2}\s*(?:[-–:.)]\s*)?[A-EX]\b"
LABEL = r"(?iu)^(?:quest(?:ão|ao)|item|gabarito)\s*:?\s*"
NUMBERS = r"(?iu)^(?:(?:item|quest(?:õ|o)es)\s+)?\d{1,3}(?:\s+\d{1,3})*$"
ANSWER_LABEL = r"(?iu)^(?:gabarito|respostas?)\s*:?\s*"
TOKENS = ("A", "B", "C", "D", "E", "X", "V", "F", "CERTO", "ERRADO", "VERDADEIRO", "FALSO", "ANULADA", "ANULADO", "0", "?", "*")
MEANT = {"V": "Certo", "F": "Errado", "CERTO": "Certo", "ERRADO": "Errado", "VERDADEIRO": "Certo", "FALSO": "Errado", "ANULADA": "Anulada", "ANULADO": "Anulada"}


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def same_line_pairs(lines: DataFrame) -> DataFrame:
    """Lines of nothing but number-letter pairs; a line with any other letter or digit is left out."""
    text = F.upper(F.regexp_replace(F.trim("linha"), LABEL, ""))
    rest = F.regexp_replace(F.regexp_replace(text, PAIR, ""), r"\b\d{1,3}\s*[:.)]\s*[*?]", "")
    pairs = lines.where(~rest.rlike("[A-Z0-9]")).select("doc", F.explode(_found(text, PAIR)).alias("p"))
    return pairs.select("doc", F.regexp_extract("p", r"([1-9]\d{0,2})", 1).cast("int").alias("numero"), F.right("p", F.lit(1)).alias("resposta"))


def two_rows(lines: DataFrame) -> DataFrame:
    """A row of numbers with an adjacent row of as many answers, under an answer label or not; gaps stay gaps."""
    w = Window.partitionBy("doc").orderBy("n")
    near = lines.withColumn("a1", F.lead("linha", 1).over(w)).withColumn("a2", F.lead("linha", 2).over(w))
    only_label = F.coalesce(F.regexp_replace(F.trim("a1"), ANSWER_LABEL, "") == "", F.lit(False))
    row = F.trim(F.regexp_replace(F.when(only_label, F.col("a2")).otherwise(F.col("a1")), ANSWER_LABEL, ""))
    near = near.where(F.trim("linha").rlike(NUMBERS)).select("doc", _found(F.col("linha"), r"\d{1,3}").alias("ns"), F.split(F.upper(row), r"\s+").alias("rs"))
    near = near.where((F.size("ns") == F.size("rs")) & F.forall("rs", lambda t: t.isin(*TOKENS)))
    tf = F.exists("rs", lambda t: t.isin("V", "F", "VERDADEIRO", "FALSO"))
    z = near.select("doc", tf.alias("tf"), F.explode(F.arrays_zip("ns", "rs")).alias("z"))
    answer = F.col("z.rs")
    meant = answer
    for k, v in MEANT.items():
        meant = F.when(answer == k, v).otherwise(meant)
    meant = F.when(F.col("tf") & (answer == "X"), "Anulada").otherwise(meant)
    z = z.select("doc", F.col("z.ns").cast("int").alias("numero"), answer.alias("t"), meant.alias("resposta"))
    return z.where("numero > 0 AND t NOT IN ('0', '?', '*')").drop("t")


def spelled_out(lines: DataFrame) -> DataFrame:
    """Answers in words after a number, on lines without other words."""
    pattern = r"\b[1-9]\d{0,2}\s*[-–:.)]?\s*(?:CERTO|ERRADO|VERDADEIRO|FALSO|ANULADA|ANULADO)\b"
    text = F.regexp_replace(F.upper("linha"), r"\b(?:QUESTÃO|QUESTAO|ITEM|GABARITO)\s*:?\s*", "")
    clean = lines.where(~F.regexp_replace(text, pattern, "").rlike(r"[\p{L}\p{N}_]"))
    p = clean.select("doc", F.explode(_found(text, pattern)).alias("p"))
    word = F.regexp_extract("p", r"([A-Z]+)$", 1)
    meant = word
    for k, v in MEANT.items():
        meant = F.when(word == k, v).otherwise(meant)
    return p.select("doc", F.regexp_extract("p", r"(\d{1,3})", 1).cast("int").alias("numero"), meant.alias("resposta"))


def item_grid(lines: DataFrame) -> DataFrame:
    """A line "Item ..." with the true/false answers of the next line, a mere label between them aside; unequal lengths give nothing, 0 is padding."""
    w = Window.partitionBy("doc").orderBy("n")
    near = lines.withColumn("_1", F.lead("linha", 1).over(w)).withColumn("_2", F.lead("linha", 2).over(w)).where(F.col("linha").rlike(r"(?i)^item\s+"))
    only_label = F.coalesce(F.regexp_replace(F.trim("_1"), ANSWER_LABEL, "") == "", F.lit(False))
    near = near.withColumn("a", F.when(only_label, F.col("_2")).otherwise(F.col("_1")))
    near = near.select("doc", _found(F.col("linha"), r"\d+").alias("ns"), _found(F.upper("a"), r"\b[CEX0]\b").alias("rs")).where(F.size("ns") == F.size("rs"))
    z = near.select("doc", F.explode(F.arrays_zip("ns", "rs")).alias("z")).select("doc", F.col("z.ns").cast("int").alias("numero"), F.col("z.rs").alias("t"))
    meant = F.when(F.col("t") == "C", "Certo").when(F.col("t") == "E", "Errado").when(F.col("t") == "X", "Anulada")
    return z.where("numero > 0 AND t <> '0'").select("doc", "numero", meant.alias("resposta"))


def version_columns(lines: DataFrame, version: str) -> DataFrame:
    """Pairs of one version: the order of the labels in the heading names the columns; a row whose pairs don't divide is left out."""
    label = r"(?i)\b(?:PROVA|TIPO|T)\s*([1-4])\b"
    heads = lines.withColumn("v", F.regexp_extract_all("linha", F.lit(label), F.lit(1))).where("size(v) > 0")
    heads = heads.groupBy("doc").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda h: h["v"]))).alias("v"))
    rows = lines.select("doc", _found(F.upper("linha"), PAIR).alias("ps")).where("size(ps) > 0").join(heads, "doc")
    at = F.array_position("v", version)
    each = (F.size("ps") / F.size("v")).cast("int")
    fits = rows.where((at > 0) & (F.size("ps") % F.size("v") == 0))
    p = fits.select("doc", F.explode(F.slice("ps", ((at - 1) * each + 1).cast("int"), each)).alias("p"))
    return p.select("doc", F.regexp_extract("p", r"([1-9]\d{0,2})", 1).cast("int").alias("numero"), F.right("p", F.lit(1)).alias("resposta"))
