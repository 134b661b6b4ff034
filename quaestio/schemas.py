"""Schemas of the bank's tables, and upgrades of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _STR, _BOOL, _TS, _DBL = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.TimestampNTZType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


OPTION = _struct(letra=_STR, texto=_STR)
TABLES: dict[str, T.StructType] = {
    "questoes": _struct(
        id=_LONG, numero_oficial=_INT, enunciado=_STR, texto_apoio=_STR, tipo=_STR, disciplina=_STR, topico=_STR, banca=_STR, ano=_INT, cargo=_STR,
        orgao=_STR, dificuldade=_STR, gabarito=_STR, comentario=_STR, imagem_path=_STR, ativa=_BOOL, criada_em=_TS,
    ),
    "alternativas": _struct(id=_LONG, questao_id=_LONG, letra=_STR, texto=_STR),
    "documentos_fonte": _struct(
        id=_LONG, sha256=_STR, tipo=_STR, identificacao_prova=_STR, cargo=_STR, ano=_INT, versao=_STR, localizacao=_STR, disponibilidade=_STR, criado_em=_TS
    ),
    "provas_cadastradas": _struct(
        id=_LONG, nome=_STR, arquivo_questoes=_STR, arquivo_gabarito=_STR, documento_fonte_questoes_id=_LONG, documento_fonte_gabarito_id=_LONG,
        instrucoes_prova=_STR, ativa=_BOOL, criada_em=_TS,
    ),
    "prova_cadastrada_questoes": _struct(prova_cadastrada_id=_LONG, questao_id=_LONG, ordem=_INT),
    "provas": _struct(id=_LONG, nome=_STR, filtros=_STR, criada_em=_TS),
    "tentativas": _struct(id=_LONG, prova_id=_LONG, iniciada_em=_TS, finalizada_em=_TS, total_acertos=_INT, nota=_DBL, tempo_gasto_seg=_INT),
    "respostas": _struct(id=_LONG, tentativa_id=_LONG, questao_id=_LONG, resposta_marcada=_STR, correta=_BOOL, tempo_resposta_seg=_INT),
}

#: Vocabularies of the domain.
EVALUABLE = ("A", "B", "C", "D", "E", "Certo", "Errado")
CONFIRMED = (*EVALUABLE, "Anulada")
KINDS = ("multipla_escolha", "certo_errado")


def upgrade(df: DataFrame, table: str) -> DataFrame:
    """The table in its present schema: missing columns become typed nulls, further ones stay at the end."""
    want = TABLES[table]
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*cols, *[c for c in df.columns if c not in want.names])
