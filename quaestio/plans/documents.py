"""Queries that link documents to each other and to catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions import text as X
from quaestio.functions.catalogs import ROLE_STOP
from quaestio.operators import documents as D
from quaestio.plans.registry import Registry
from quaestio.plans.texts import _ACC
from quaestio.session import table

query = Registry()
_TOK = "list_sort(list_distinct(list_filter(regexp_extract_all({}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(repr(w) for w in ROLE_STOP) + "))))"


@query(f"""WITH v AS (SELECT DISTINCT {_ACC.format('cargo')} AS c FROM questoes WHERE cargo IS NOT NULL), t AS (SELECT c, {_TOK.format('c')} AS a FROM v),
l AS (SELECT ref_id, {_TOK.format(_ACC.format('nome'))} AS b FROM lista_canonica WHERE campo = 'cargo')
SELECT c AS cargo, ref_id FROM t, l WHERE len(a) > 0 AND (a = b OR (len(list_intersect(a, b)) >= 2 AND least(len(list_intersect(a, b)) / len(a), len(list_intersect(a, b)) / len(b)) >= 0.75))""")
def label_overlap(spark, d):
    """Typed roles and listed ones that are one label by their words; they meet by a word in common."""
    v = table(spark, d, "questoes").where("cargo IS NOT NULL").select(X.accent_key(F.col("cargo")).alias("cargo")).distinct()
    v = v.withColumn("a", X.key_tokens(F.col("cargo"), ROLE_STOP)).where("size(a) > 0")
    c = table(spark, d, "lista_canonica").where("campo = 'cargo'").select("ref_id", X.key_tokens(F.col("nome"), ROLE_STOP).alias("b"))
    j = v.withColumn("w", F.explode("a")).join(c.withColumn("w", F.explode("b")), "w")
    return j.where(D.labels_overlap(F.col("a"), F.col("b"), 2)).select("cargo", "ref_id").distinct()


_V = r"upper(regexp_replace(trim(versao), '(?i)^(?:prova\s+tipo|prova|tipo|t)\s*', ''))"
_VERSION = f"nullif(CASE {_V} WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4' WHEN 'V' THEN '5' WHEN 'X' THEN '10' ELSE {_V} END, '')"
# every booklet with every key, without any blocking
_P = f"""p0 AS (SELECT id AS doc, tipo, nullif(upper(trim(identificacao_prova)), '') AS codigo, ano, {_VERSION} AS versao, {_TOK.format(_ACC.format('cargo'))} AS w0 FROM documentos_fonte),
p AS (SELECT *, CASE WHEN len(w0) > 0 THEN w0 END AS w FROM p0),
j AS (SELECT a.doc AS caderno, b.doc AS gabarito, a.codigo AS ca, b.codigo AS cb, a.ano = b.ano AS mesmo_ano, a.versao AS va, b.versao AS vb, a.w AS wa, b.w AS wb FROM p a, p b WHERE a.tipo = 'caderno' AND b.tipo = 'gabarito'),
o AS (SELECT *, coalesce(wa = wb OR (len(list_intersect(wa, wb)) >= 2 AND least(len(list_intersect(wa, wb)) / greatest(len(wa), 1), len(list_intersect(wa, wb)) / greatest(len(wb), 1)) >= 0.75), false) AS mw FROM j),
s AS (SELECT caderno, gabarito, ca = cb AS mc, va = vb AS mv, wa IS NOT NULL AND wb IS NOT NULL AND mw AS mr, (20 + CASE WHEN ca = cb THEN 60 ELSE 0 END + CASE WHEN mesmo_ano THEN 12 ELSE 0 END + CASE WHEN va = vb THEN 25 ELSE 0 END + CASE WHEN wa IS NOT NULL AND wb IS NOT NULL AND mw THEN 30 ELSE 0 END)::INTEGER AS pontos,
 CASE WHEN ca <> cb THEN 'identificadores' WHEN va <> vb THEN 'modelo_versao' WHEN wa IS NOT NULL AND wb IS NOT NULL AND NOT mw THEN 'cargo' END AS eliminado_em FROM o),
f AS (SELECT caderno, gabarito, pontos, eliminado_em, CASE WHEN eliminado_em IS NOT NULL THEN 'descartada' WHEN pontos >= 75 AND coalesce(mc, false) AND (coalesce(mv, false) OR mr) THEN 'candidato_forte_revisao' WHEN pontos >= 35 THEN 'candidato_revisao' ELSE 'revisao_manual' END AS decisao FROM s)"""


def _booklets_and_keys(spark, d):
    p = D.profiles(table(spark, d, "documentos_fonte"))
    return p.where("tipo = 'caderno'"), p.where("tipo = 'gabarito'")


@query(f"WITH {_P} SELECT caderno, gabarito, pontos, decisao FROM f WHERE decisao LIKE 'candidato%'")
def funnel_scores(spark, d):
    """Every candidate of the funnel with its points: pairs of a booklet and a key that no stage discards and that reach 35."""
    return D.candidates(*_booklets_and_keys(spark, d))


@query(f"WITH {_P} SELECT caderno, count(*) AS pares, count(*) FILTER (eliminado_em IS NULL OR eliminado_em <> 'identificadores') AS apos_identificadores, count(*) FILTER (eliminado_em IS NULL OR eliminado_em = 'cargo') AS apos_versao, count(*) FILTER (eliminado_em IS NULL) AS finais FROM f GROUP BY 1")
def funnel_survivors(spark, d):
    """How many of all keys outlive each stage for each booklet."""
    return D.survivors(*_booklets_and_keys(spark, d))


@query(f"WITH {_P} SELECT caderno, gabarito, pontos, posicao::INTEGER AS posicao FROM (SELECT *, row_number() OVER (PARTITION BY caderno ORDER BY pontos DESC, gabarito) AS posicao FROM f WHERE eliminado_em IS NULL) WHERE posicao <= 5")
def top_candidates(spark, d):
    """The five best keys of each booklet."""
    return D.top_candidates(*_booklets_and_keys(spark, d), 5)


@query("""WITH a AS (SELECT l.prova_cadastrada_id AS id, list_distinct(list(q.numero_oficial) FILTER (q.numero_oficial IS NOT NULL)) AS c, list_distinct(list(l.ordem) FILTER (q.gabarito IS NOT NULL)) AS g FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id GROUP BY 1)
SELECT id, len(list_filter(c, lambda x: NOT list_contains(g, x)))::INTEGER AS faltam, len(list_filter(g, lambda x: NOT list_contains(c, x)))::INTEGER AS sobram, len(list_intersect(c, g))::INTEGER AS comuns,
CASE WHEN len(list_intersect(c, g)) = 0 THEN 'incompativel' WHEN len(list_filter(g, lambda x: NOT list_contains(c, x))) > 0 THEN 'incompativel' WHEN len(list_filter(c, lambda x: NOT list_contains(g, x))) > 0 THEN 'incompleto' ELSE 'correspondente' END AS estado FROM a""")
def association_state(spark, d):
    """Numbers of a booklet and of its key: missing, extra, in common, and what that makes of the pair."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "numero_oficial", "gabarito")
    g = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").groupBy(F.col("prova_cadastrada_id").alias("id"))
    g = g.agg(F.collect_set("numero_oficial").alias("c"), F.collect_set(F.when(F.col("gabarito").isNotNull(), F.col("ordem"))).alias("g"))
    miss, extra, both = F.size(F.array_except("c", "g")), F.size(F.array_except("g", "c")), F.size(F.array_intersect("c", "g"))
    state = F.when((both == 0) | (extra > 0), "incompativel").when(miss > 0, "incompleto").otherwise("correspondente")
    return g.select("id", miss.alias("faltam"), extra.alias("sobram"), both.alias("comuns"), state.alias("estado"))


_N = r"trim(regexp_replace(replace(lower(regexp_replace({}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT id, string_split({_N.format('enunciado')}, ' ') AS w FROM questoes), a AS (SELECT id, array_to_string(w[1:14], ' ') AS k FROM q WHERE len(w) >= 14),
n AS (SELECT k, min(id) AS novo, count(*) AS c FROM a WHERE id % 2 = 1 GROUP BY 1)
SELECT a.id, CASE WHEN c = 1 THEN novo END AS novo, CASE WHEN c IS NULL THEN 'sem_ancora' WHEN c > 1 THEN 'ambigua' ELSE 'vinculada' END AS situacao FROM a LEFT JOIN n USING (k) WHERE a.id % 2 = 0""")
def content_anchor_match(spark, d):
    """Each question of even id and the only one of odd id that starts with the same fourteen words."""
    a = D.anchors(table(spark, d, "questoes"), "id", "enunciado", 14)
    return D.anchor_match(a.where("id % 2 = 0"), a.where("id % 2 = 1"))


@query()
def ordered_anchor(spark, d):
    """Documents that begin with the first words of an evaluation item, some of them skipped or misread."""
    items = table(spark, d, "itens_avaliacao").select(F.col("item_id").alias("ref_id"), "texto")
    return D.ordered_anchor(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto")), items)


@query(f"""WITH k AS (SELECT campo, {_ACC.format('nome')} AS c, min(ref_id) AS ref_id, count(*) AS n FROM lista_canonica GROUP BY 1, 2)
SELECT q.id, 'banca' AS campo, CASE WHEN n = 1 THEN ref_id END AS ref_id, CASE WHEN n IS NULL THEN 'ausente' WHEN n > 1 THEN 'ambigua' ELSE 'encontrada' END AS situacao FROM questoes q LEFT JOIN k ON k.campo = 'banca' AND k.c = {_ACC.format('q.banca')} WHERE q.banca IS NOT NULL""")
def catalogue_lookup(spark, d):
    """Typed boards by exact normalized key in the catalogue."""
    wanted = table(spark, d, "questoes").where("banca IS NOT NULL").select("id", F.lit("banca").alias("campo"), F.col("banca").alias("valor"))
    return D.catalogue(table(spark, d, "lista_canonica"), wanted)
