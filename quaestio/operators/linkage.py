"""Answer keys: linking them to questions, merging sources, and reports. Ambiguity never yields an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.functions.keys import LETTERS, TF, normalize_key

#: Spellings of one answer in different sources.
SAME = {"X": "Anulada", "ANULADA": "Anulada", "CERTO": "Certo", "ERRADO": "Errado"}


def same_answer(answer: Column) -> Column:
    out = answer
    for seen, meant in SAME.items():
        out = F.when(F.upper(answer) == seen, meant).otherwise(out)
    return out


def merge_observations(observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resposta, conflito) of one level of sources: a number with two different answers has none and is a conflict."""
    agg = observed.groupBy(*keys).agg(F.min(same_answer(F.col("resposta"))).alias("a"), F.max(same_answer(F.col("resposta"))).alias("b"))
    clash = F.col("a") != F.col("b")
    return agg.select(*keys, F.when(~clash, F.col("a")).alias("resposta"), clash.alias("conflito"))


def fill_by_priority(observed: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """(keys, resposta, conflito, priority): each number from the best level that has it.

    A level counts for a number by an answer or by a conflict, so what conflicts at a higher level is
    never refilled by a lower one.
    """
    level = merge_observations(observed, [*keys, priority])
    best = level.groupBy(*keys).agg(F.min_by(F.struct("resposta", "conflito", priority), priority).alias("m"))
    return best.select(*keys, "m.*")


def link_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each question and each unmet answer, with ``situacao`` and the linked ``resposta``.

    questions: escopo, numero, questao_id, tipo, gabarito, letras (letters of non-blank options, null if
    unknown). answers: escopo (null means any), numero, resposta; at most one a (escopo, numero). An
    answer for any scope is not used where its number stands in several scopes. Nothing is linked by position.
    """
    per = Window.partitionBy("escopo", "numero")
    q = questions.withColumn("iguais", F.count("*").over(per))
    spread_over = q.where("numero IS NOT NULL").groupBy("numero").agg(F.countDistinct("escopo").alias("escopos"))
    scoped = answers.where("escopo IS NOT NULL").select("escopo", "numero", F.col("resposta").alias("propria"))
    anywhere = answers.where("escopo IS NULL").select("numero", F.col("resposta").alias("geral"))
    j = q.join(spread_over, "numero", "left").join(scoped, ["escopo", "numero"], "left").join(anywhere, "numero", "left")
    usable = F.when(F.col("escopos") == 1, F.col("geral"))
    given = F.coalesce("propria", usable)
    new = normalize_key(given, F.col("tipo"))
    old = normalize_key(F.col("gabarito"), F.col("tipo"))
    no_option = (F.coalesce(F.col("tipo"), F.lit("")) != TF) & F.col("letras").isNotNull() & new.isin(*LETTERS) & ~F.array_contains("letras", new)
    state = (
        F.when(F.col("numero").isNull(), "numeracao")
        .when(F.col("iguais") > 1, "duplicado")
        .when(F.col("propria").isNull() & F.col("geral").isNotNull() & (F.col("escopos") > 1), "escopo_divergente")
        .when(given.isNull(), "faltante")
        .when(new.isNull() | no_option, "incompativel")
        .when(old.isNotNull() & (old != new), "conflito")
        .otherwise("vinculada")
    )
    linked = j.select("escopo", "numero", "questao_id", state.alias("situacao"), F.when(state == "vinculada", new).alias("resposta"))
    extra = answers.join(spread_over.select("numero"), "numero", "left_anti")
    extra = extra.select("escopo", "numero", F.lit(None).cast("long").alias("questao_id"), F.lit("extra").alias("situacao"), F.lit(None).cast("string").alias("resposta"))
    return linked.unionByName(extra)


def coverage(links: DataFrame, group: str) -> DataFrame:
    """(group, extraidas, vinculadas, cobertura, ganho_possivel): how many questions got an answer, best gain first."""
    q = links.where("situacao <> 'extra'")
    agg = q.groupBy(group).agg(F.count("*").alias("extraidas"), F.count_if(F.col("situacao") == "vinculada").alias("vinculadas"))
    share = F.when(F.col("extraidas") > 0, F.col("vinculadas") / F.col("extraidas")).otherwise(0.0)
    return agg.withColumn("cobertura", F.round(share, 6)).withColumn("ganho_possivel", F.col("extraidas") - F.col("vinculadas"))


def sequence_gaps(df: DataFrame, group: str, number: str, declared: Column | None = None) -> DataFrame:
    """(group, faltam): numbers from 1 to the greatest seen (or declared) that are missing, as text."""
    agg = df.where(F.col(number) > 0).groupBy(group).agg(F.collect_set(number).alias("seen"), F.max(number).alias("top"))
    top = F.greatest("top", declared) if declared is not None else F.col("top")
    gaps = F.array_sort(F.array_except(F.sequence(F.lit(1), top), F.col("seen")))
    return agg.select(group, F.array_join(gaps.cast("array<string>"), ",").alias("faltam"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def mode(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value that isn't null or empty; of equal ones the greatest."""
    n = df.where(F.col(value) != "").groupBy(group, value).agg(F.count("*").alias("n"))
    return n.groupBy(group).agg(F.max(F.struct("n", value)).alias("m")).select(group, f"m.{value}", "m.n")
