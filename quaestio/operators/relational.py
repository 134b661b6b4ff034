"""Relational reads over the bank. All stay declarative: no Python in the data path, no collected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.functions.keys import LETTERS, normalize_key
from quaestio.schemas import CONFIRMED, EVALUABLE, KINDS


def optional_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Equality filters; empty values are ignored."""
    return reduce(lambda out, kv: out.where(F.col(kv[0]) == kv[1]), [x for x in filters.items() if x[1]], df)


def search(questions: DataFrame, text: str, filters: dict[str, object]) -> DataFrame:
    """Active questions whose stem contains ``text``, letter case ignored."""
    return optional_filters(questions.where("ativa"), filters).where(F.contains(F.lower("enunciado"), F.lit(text.lower())))


def with_options(questions: DataFrame, options: DataFrame) -> DataFrame:
    """Questions with ``opcoes``, an array of (letra, texto); empty where there are none.

    Options are gathered ahead of the join, so the join moves one row a question.
    """
    nested = options.groupBy(F.col("questao_id").alias("id")).agg(F.collect_list(F.struct("letra", "texto")).alias("opcoes"))
    empty = F.array().cast("array<struct<letra:string,texto:string>>")
    return questions.join(nested, "id", "left").withColumn("opcoes", F.coalesce("opcoes", empty))


def option_texts() -> Column:
    one = F.transform("opcoes", lambda o: F.concat(F.coalesce(o["letra"], F.lit("")), F.lit(")"), F.coalesce(o["texto"], F.lit(""))))
    return F.array_sort(one)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(campo, valor): distinct values that are neither null nor empty, in one pass over the table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("valor")) for c in columns])).alias("p")
    return df.select(pairs).select("p.*").where("valor <> ''").distinct()


def evaluable(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("ativa") & F.col("gabarito").isin(*EVALUABLE))


def structure_problems(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(id, problemas): comma-separated codes in a fixed order; an empty text where there are none."""
    text = F.coalesce("texto", F.lit(""))
    per = options.groupBy(F.col("questao_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.col("letra")))).alias("letras"),
        F.max(text.rlike(r"\s[b-eB-E]\)\s+\S") & ~F.contains(text, F.lit("("))).alias("fundida"),
    )
    q = questions.join(per, "id", "left")
    stem = F.coalesce("enunciado", F.lit(""))
    mc = F.coalesce(F.col("tipo") == KINDS[0], F.lit(False))
    letters = F.coalesce("letras", F.array().cast("array<string>"))
    rules = [
        (F.trim(stem) == "", "enunciado_vazio"),
        ((F.coalesce("gabarito", F.lit("")) != "") & normalize_key(F.col("gabarito"), F.col("tipo")).isNull(), "gabarito_incompativel"),
        (stem.rlike(r"(?iu)(^|[^\p{L}\p{N}_])(alternativa que|afirmação que)\s*$"), "comando_incompleto"),
        (mc & ((F.size(letters) < 2) | (letters != F.slice(F.array(*map(F.lit, LETTERS)), F.lit(1), F.size(letters)))), "alternativas_invalidas"),
        (mc & F.col("gabarito").isin(*LETTERS) & ~F.array_contains(letters, F.col("gabarito")), "alternativa_do_gabarito_ausente"),
        (mc & F.coalesce("fundida", F.lit(False)), "alternativas_fundidas"),
        (stem.rlike(r"(?iu)TIPO\s+[\p{L}\p{N}_]+\s*[–—-]\s*P[ÁA]GINA\s+\d+"), "rodape_misturado"),
    ]
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for rule, code in rules]))
    return q.select("id", F.array_join(codes, ",").alias("problemas"))


def first_error(questions: DataFrame, options: DataFrame) -> DataFrame:
    """(id, erro): the first rule of the editor that fails."""
    letter = F.upper(F.trim("letra"))
    per = options.groupBy(F.col("questao_id").alias("id")).agg(
        F.count("*").alias("n"), F.countDistinct(F.when(letter.isin(*LETTERS), letter)).alias("u"), F.collect_list(letter).alias("l")
    )
    q = questions.join(per, "id", "left")
    key, mc = normalize_key(F.col("gabarito"), F.col("tipo")), F.col("tipo") == KINDS[0]
    rules = [
        (F.trim(F.coalesce("enunciado", F.lit(""))) == "", "enunciado_vazio"),
        (F.col("tipo").isNull() | ~F.col("tipo").isin(*KINDS), "tipo_invalido"),
        (mc & (F.coalesce("n", F.lit(0)) < 2), "poucas_opcoes"),
        (mc & (F.col("u") != F.col("n")), "letras_repetidas"),
        (F.col("gabarito").isNotNull() & key.isNull(), "gabarito_invalido"),
        (mc & (F.length(key) == 1) & ~F.array_contains("l", key), "opcao_do_gabarito_ausente"),
        ((F.col("ano") < 1900) | (F.col("ano") > 2100), "ano_invalido"),
    ]
    return q.select("id", F.coalesce(*[F.when(rule, F.lit(code)) for rule, code in rules]).alias("erro"))


def exam_readiness(exams: DataFrame, links: DataFrame, questions: DataFrame) -> DataFrame:
    keys = questions.select(F.col("id").alias("questao_id"), F.col("gabarito").isin(*CONFIRMED).alias("k"))
    per = links.join(keys, "questao_id").groupBy("prova_cadastrada_id").agg(F.count("*").alias("n"), F.count_if("k").alias("c"))
    joined = exams.join(per.withColumnRenamed("prova_cadastrada_id", "id"), "id", "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))
    return joined.select(
        "id", "nome", n.alias("n_questoes"), c.alias("n_com_gabarito"), (n - c).alias("n_sem_gabarito"), ((n > 0) & (n == c)).alias("pronta")
    )


def only_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with exactly one distinct value."""
    agg = df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return agg.where(F.col(value) == F.col("_max")).select(key, value)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(t).alias("tabela"), F.count("*").alias("n")) for t, df in tables.items()])


def audit(questions: DataFrame, options: DataFrame, responses: DataFrame, attempts: DataFrame, exams: DataFrame) -> DataFrame:
    ids = questions.select(F.col("id").alias("questao_id"))
    cases = {
        "opcao_sem_questao": options.join(ids, "questao_id", "left_anti").agg(F.count("*").alias("n")),
        "resposta_sem_tentativa": responses.join(attempts.select(F.col("id").alias("tentativa_id")), "tentativa_id", "left_anti").agg(F.count("*").alias("n")),
        "resposta_repetida": responses.agg((F.count("*") - F.countDistinct("id")).alias("n")),
        "prova_sem_fonte_de_gabarito": exams.agg(F.count_if(F.col("documento_fonte_gabarito_id").isNull()).alias("n")),
        "questao_de_multipla_escolha_sem_opcoes": questions.where(F.col("tipo") == KINDS[0])
        .join(options.select(F.col("questao_id").alias("id")), "id", "left_anti")
        .agg(F.count("*").alias("n")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(c).alias("caso"), "n") for c, df in cases.items()])


def raw_sql(spark: SparkSession, statement: str, args: dict, **tables: DataFrame) -> DataFrame:
    """A SQL statement with named parameters over DataFrames named in braces."""
    return spark.sql(statement, args, **tables)
