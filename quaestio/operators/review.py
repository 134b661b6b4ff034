"""Evidence, review, staging and scope: decisions over rows that people and readers supply.

Nothing here approves anything: operators validate, compare and count, and say why a row is not accepted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ("prova", "cargo", "codigo", "versao")
#: Parts that evidence may stand for, and states a key may have.
PARTS = ("conteudo", "contexto", "recurso_visual", "gabarito")
KEY_STATES = ("preliminar", "definitivo", "documento_fornecido", "anulado", "conflitante")


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def first_code(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first rule that holds, or null; a rule that is null doesn't hold."""
    return F.coalesce(*[F.when(rule, F.lit(code)) for rule, code in rules])


def evidence_error(page_width: str = "largura", page_height: str = "altura") -> Column:
    """Why a row of evidence is refused, or null: part, scope, key state, page, rotation and box are tested in this order."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    box = ("x0", "y0", "x1", "y1")
    return first_code([
        (~F.coalesce(F.col("parte").isin(*PARTS), F.lit(False)), "parte_invalida"),
        (reduce(lambda a, b: a | b, [blank(c) for c in SCOPE]), "escopo_incompleto"),
        ((F.col("parte") == "gabarito") & ~F.coalesce(F.col("situacao").isin(*KEY_STATES), F.lit(False)), "situacao_ausente"),
        (F.col("pagina").isNull() | (F.col("pagina") < 1), "pagina_invalida"),
        (~F.coalesce(F.col("rotacao"), F.lit(0)).isin(0, 90, 180, 270), "rotacao_invalida"),
        (~reduce(lambda a, b: a & b, [fine(c) for c in box]), "coordenadas_invalidas"),
        ((F.col("x0") < 0) | (F.col("y0") < 0) | (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), "regiao_invalida"),
        (~(fine(page_width) & fine(page_height) & (F.col(page_width) > 0) & (F.col(page_height) > 0)), "pagina_sem_dimensoes"),
        ((F.col("x1") > F.col(page_width)) | (F.col("y1") > F.col(page_height)), "regiao_fora_da_pagina"),
    ])


def append_evidence(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, resets): valid rows without repeats, and (key, revisao_conteudo, revisao_gabarito) that they reopen.

    A row repeats another of its key with the same part, page, box and scope; the first in ``order`` stays.
    New evidence of the content reopens its review, new evidence of the key that of the answer; null means untouched.
    """
    same = [key, "parte", "pagina", "x0", "y0", "x1", "y1", *SCOPE]
    ok = rows.where(evidence_error().isNull())
    kept = ok.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy(order))).where("_k = 1").drop("_k")
    has = F.max((F.col("parte") == "gabarito").cast("int")), F.max((F.col("parte") != "gabarito").cast("int"))
    resets = kept.groupBy(key).agg(F.when(has[1] == 1, "pendente").alias("revisao_conteudo"), F.when(has[0] == 1, "desconhecido").alias("revisao_gabarito"))
    return kept, resets


def same_scope(a: DataFrame, b: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, a, b): rows of one key whose scopes agree in all four fields; a missing field equals a missing one."""
    x = a.select(key, F.col(id_col).alias("a"), *[F.col(c).alias(f"_{c}") for c in SCOPE])
    y = b.select(F.col(key).alias("_key"), F.col(id_col).alias("b"), *SCOPE)
    on = [F.col(key) == F.col("_key"), *[F.col(f"_{c}").eqNullSafe(F.col(c)) for c in SCOPE]]
    return x.join(y, on).select(key, "a", "b")


def first_match(diagnostics: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(diagnostico, evidencia): for each diagnostic the first evidence it lists, else the first of its part, else null.

    diagnostics: diagnostico, key, parte, ids (array); evidence: id, key, parte.
    """
    e = evidence.select(key, F.col("id").alias("_id"), F.col("parte").alias("_parte"))
    j = diagnostics.join(e, key, "left")
    listed, part = F.array_contains("ids", F.col("_id")), F.col("_parte") == F.col("parte")
    rank = F.when(listed, 0).when(part, 1)
    return j.groupBy("diagnostico").agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "_id"))).alias("m")).select("diagnostico", F.col("m._id").alias("evidencia"))


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(chave, estado, resultado) of decisions on staged proposals: only pending ones change, and only once.

    proposals: chave, estado. decisions: chave, decisao, responsavel, justificativa. Two decisions on one
    proposal decide nothing.
    """
    several = F.count("*").over(Window.partitionBy("chave")) > 1
    j = decisions.withColumn("_several", several).join(proposals, "chave", "left")
    result = first_code([
        (F.coalesce(~F.col("decisao").isin("aprovada", "rejeitada"), F.lit(True)) | blank("responsavel") | blank("justificativa"), "recusada"),
        (F.col("estado").isNull(), "inexistente"), (F.col("_several"), "concorrente"), (F.col("estado") != "pendente", "ja_decidida"),
    ])
    done = F.coalesce(result, F.lit("registrada"))
    return j.select("chave", F.when(done == "registrada", F.col("decisao")).otherwise(F.col("estado")).alias("estado"), done.alias("resultado"))


def integrity(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, disponivel, integro, motivo) of registered sources against the files there are (localizacao, sha256_atual)."""
    j = sources.join(files, "localizacao", "left")
    there = F.col("sha256_atual").isNotNull()
    whole = F.coalesce(F.col("sha256") == F.col("sha256_atual"), F.lit(False))
    why = F.when(~there, "arquivo_ausente").when(F.col("sha256").isNull(), "hash_desconhecido").when(whole, "integro").otherwise("hash_divergente")
    return j.select("id", there.alias("disponivel"), (there & whole).alias("integro"), why.alias("motivo"))


def issues_of_number(issues: DataFrame, numbers: DataFrame, key: str) -> DataFrame:
    """(key, numero, defeito): a defect that names a number holds for it alone, any other for every number of its document."""
    number = F.regexp_extract("defeito", r"^(?:ancora_nao_encontrada|marcador_duplicado):(\d+)$", 1).try_cast("int")
    i = issues.select(F.col(key).alias("_key"), "defeito", number.alias("_n"))
    return numbers.join(i, (F.col(key) == F.col("_key")) & (F.col("_n").isNull() | (F.col("_n") == F.col("numero")))).select(key, "numero", "defeito")


def derived_scope(meta: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``meta`` with ``escopo_<field>``: the value that booklet (a_<field>) and key (b_<field>) have in common, where each field has exactly one; else all null."""
    common = {f: F.array_intersect(F.coalesce(f"a_{f}", F.array()), F.coalesce(f"b_{f}", F.array())) for f in fields}
    one = reduce(lambda a, b: a & b, [F.size(c) == 1 for c in common.values()])
    return meta.select("*", *[F.when(one, c[0]).alias(f"escopo_{f}") for f, c in common.items()])


def scope_question(chosen: Column, offered: Column, book: Column) -> Column:
    """Why a choice of scope doesn't hold, or null: several offered and none chosen, or one the booklet doesn't name."""
    none = F.coalesce(chosen, F.lit("")) == ""
    return F.when(none & (F.size(offered) > 1), "escolher").when(~none & (F.size(book) > 0) & ~F.array_contains(book, chosen), "divergente")


def answer_evidence(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, numero, resposta, situacao) for each expected number of a key document.

    observed: key, numero, pagina, regiao, resposta; expected: key, numero, esperada (may be null). Different
    answers, or one that isn't the expected one, conflict. The same answer in two places is ambiguous, unless all places are on
    pages that each hold the whole expected board with equal answers.
    """
    seen = observed.join(expected.select(key, "numero"), [key, "numero"], "left_semi")
    pages = seen.groupBy(key, "pagina").agg(F.array_sort(F.collect_set(F.struct("numero", "resposta"))).alias("_quadro"), F.countDistinct("numero").alias("_n"))
    size = expected.groupBy(key).agg(F.countDistinct("numero").alias("_todos"))
    whole = pages.join(size, key).where((F.col("_n") == F.col("_todos")) & (F.size("_quadro") == F.col("_n")))
    twice = whole.withColumn("_iguais", F.count("*").over(Window.partitionBy(key, F.xxhash64("_quadro")))).where("_iguais > 1").select(key, "pagina", F.lit(True).alias("_copia"))
    per = seen.join(twice, [key, "pagina"], "left").groupBy(key, "numero").agg(
        F.min("resposta").alias("_a"), F.max("resposta").alias("_b"), F.countDistinct("pagina", "regiao").alias("_lugares"), F.min(F.coalesce("_copia", F.lit(False))).alias("_copias")
    )
    j = expected.join(per, [key, "numero"], "left")
    state = first_code([
        (F.col("_a").isNull(), "ausente"), ((F.col("_a") != F.col("_b")) | (F.col("esperada") != F.col("_a")), "conflito"),
        ((F.col("_lugares") > 1) & ~F.col("_copias"), "ambigua"), (F.col("_lugares") > 1, "duplicado_identico"),
    ])
    state = F.coalesce(state, F.lit("encontrada"))
    return j.select(key, "numero", F.when(state.isin("encontrada", "duplicado_identico"), F.col("_a")).alias("resposta"), state.alias("situacao"))


def diagnostic_target(code: Column, stage: Column, part: Column) -> Column:
    """The field that a diagnostic is about."""
    has = lambda t: F.contains(code, F.lit(t))
    rules = (
        (has("numeracao") | (stage == "numeracao"), "numero_oficial"), (code.isin("alternativas_invalidas", "alternativas_possivelmente_fundidas"), "alternativas"),
        (has("gabarito") | (part == "gabarito") | stage.isin("associacao_gabarito", "confirmacao_gabarito"), "gabarito"), (part == "contexto", "texto_apoio"),
    )
    return F.coalesce(*[F.when(r, F.lit(t)) for r, t in rules], F.lit("enunciado"))


def evaluation(cases: DataFrame, split: str) -> DataFrame:
    """Of cases (obtido, proposta, esperado, texto): counts by split of matches, wrong proposals, abstentions and unresolved ones."""
    got, want = F.col("obtido"), F.col("esperado")
    same = F.coalesce(F.col("proposta") == F.col("texto"), F.lit(False))
    meets = F.when(want == "proposta", (got == "proposta") & same).otherwise(got == want)
    wrong = (got == "proposta") & ((want != "proposta") | ~same)
    return cases.groupBy(split).agg(
        F.count("*").alias("casos"), F.count_if(meets).alias("corretos"), F.count_if(wrong).alias("propostas_erradas"), F.count_if(want == "abster").alias("abstencoes_exigidas"),
        F.count_if((want == "abster") & meets).alias("abstencoes_seguras"), F.count_if(got.isin("abster", "divergencia") & (want != "abster")).alias("sem_solucao"),
    )


def split_leak(cases: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(chave, valor): values of a key column that stand in more than one split."""
    parts = [cases.where(F.col(k).isNotNull()).groupBy(F.col(k).cast("string").alias("valor")).agg(F.countDistinct(split).alias("_n")).where("_n > 1").select(F.lit(k).alias("chave"), "valor") for k in keys]
    return reduce(DataFrame.unionByName, parts)


def positional(a: DataFrame, b: DataFrame, group: str, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of two tables joined by their place in the order of each group; what one side has beyond the other meets null."""
    at = lambda df, order: df.withColumn("posicao", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return at(a, order_a).drop(*order_a).join(at(b, order_b).drop(*order_b), [group, "posicao"], "full")
