"""Queries over versions, sources, proposals and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions.keys import normalize_key
from quaestio.operators import history as H
from quaestio.operators.documents import anchors
from quaestio.plans.registry import Registry
from quaestio.plans.sql import key_sql
from quaestio.session import table

query = Registry()
CONTENT = ["ano", "disciplina", "enunciado", "gabarito", "tipo"]
_HASH = "sha256(to_json({'ano': ano, 'disciplina': disciplina, 'enunciado': enunciado, 'gabarito': gabarito, 'tipo': tipo}))"


def _current(spark, d):
    return table(spark, d, "questoes").select(F.col("id").alias("questao_id"), H.signature(CONTENT).alias("hash_conteudo"))


def _log(spark, d):
    """A version log: two thirds of the questions as they are, every fifth with an older content on top."""
    now = _current(spark, d).where("questao_id % 3 <> 0").select("questao_id", F.lit(1).alias("numero_versao"), "hash_conteudo")
    old = _current(spark, d).where("questao_id % 5 = 0").select("questao_id", F.lit(2).alias("numero_versao"), F.md5("hash_conteudo").alias("hash_conteudo"))
    return now.unionByName(old)


@query(f"SELECT id AS questao_id, {_HASH} AS hash_conteudo FROM questoes")
def content_signature(spark, d):
    """The digest of each question's content."""
    return _current(spark, d)


_LOG = f"""c AS (SELECT id AS questao_id, {_HASH} AS h FROM questoes), l AS (SELECT questao_id, 1 AS v, h FROM c WHERE questao_id % 3 <> 0 UNION ALL SELECT questao_id, 2, md5(h) FROM c WHERE questao_id % 5 = 0),
t AS (SELECT questao_id, max(v) AS v, max_by(h, v) AS h FROM l GROUP BY 1)"""


@query(f"WITH {_LOG} SELECT questao_id, v AS numero_versao, h AS hash_conteudo FROM t")
def latest_version(spark, d):
    """The latest version of each question."""
    return H.latest(_log(spark, d), "questao_id", "numero_versao")


@query(f"WITH {_LOG} SELECT c.questao_id, coalesce(t.v, 0) + 1 AS numero_versao, c.h AS hash_conteudo FROM c LEFT JOIN t USING (questao_id) WHERE t.h IS NULL OR t.h <> c.h")
def version_append_idempotent(spark, d):
    """The versions to append: only where the content changed."""
    return H.versions_to_append(_current(spark, d), _log(spark, d), "questao_id")


@query("""WITH n AS (SELECT id + 100000 AS id, sha256, tipo, 'novo/' || id AS localizacao, 1 AS k FROM documentos_fonte WHERE id % 2 = 0), b AS (SELECT id, sha256, tipo, localizacao, 0 AS k FROM documentos_fonte UNION ALL SELECT * FROM n)
SELECT min_by(id, k * 10000000 + id) AS id, sha256, min_by(tipo, k * 10000000 + id) AS tipo, max_by(localizacao, k * 10000000 + id) FILTER (localizacao IS NOT NULL) AS localizacao FROM b WHERE sha256 IS NOT NULL GROUP BY sha256
UNION ALL SELECT id, sha256, tipo, localizacao FROM b WHERE sha256 IS NULL""")
def source_dedup_sha(spark, d):
    """Source documents after half of them came again from another place."""
    have = table(spark, d, "documentos_fonte").select("id", "sha256", "tipo", "localizacao")
    new = have.where("id % 2 = 0").select((F.col("id") + 100000).alias("id"), "sha256", "tipo", F.concat(F.lit("novo/"), F.col("id").cast("string")).alias("localizacao"))
    return H.upsert_sources(have, new, "sha256", "id")


@query("""WITH h AS (SELECT registro_id, arquivo FROM importacoes_brutas WHERE registro_id % 2 = 0) SELECT * FROM h UNION ALL SELECT registro_id, 'segunda' FROM importacoes_brutas WHERE registro_id % 2 <> 0 AND registro_id % 3 = 0""")
def insert_or_ignore(spark, d):
    """Records inserted twice: those already there are ignored."""
    r = table(spark, d, "importacoes_brutas")
    have = r.where("registro_id % 2 = 0").select("registro_id", "arquivo")
    new = r.where("registro_id % 3 = 0").select("registro_id", F.lit("segunda").alias("arquivo"))
    return H.insert_or_ignore(have, new.unionByName(new), "registro_id")


@query("""SELECT arquivo, registro_id, strftime(recebido_em, '%Y-%m-%d %H:%M:%S') AS recebido FROM (SELECT *, row_number() OVER (PARTITION BY arquivo ORDER BY recebido_em DESC, registro_id DESC) AS k FROM importacoes_brutas) WHERE k = 1""")
def latest_record_of_file(spark, d):
    """The last received record of each file."""
    r = table(spark, d, "importacoes_brutas").select("arquivo", "registro_id", "recebido_em")
    return H.latest_wins(r, ["arquivo"], ["recebido_em", "registro_id"]).select("arquivo", "registro_id", F.date_format("recebido_em", "yyyy-MM-dd HH:mm:ss").alias("recebido"))


@query(f"SELECT id, CASE WHEN id % 4 = 0 AND {key_sql('gabarito', 'tipo')} IS NOT NULL THEN {key_sql('gabarito', 'tipo')} ELSE gabarito END AS gabarito, CASE WHEN id % 4 = 0 THEN coalesce(topico, 'Geral') ELSE topico END AS topico, ativa AND id % 10 <> 3 AS ativa FROM questoes")
def update_overlay(spark, d):
    """Questions after partial updates and soft deletes."""
    q = table(spark, d, "questoes").select("id", "gabarito", "topico", "ativa", "tipo")
    changes = q.where("id % 4 = 0").select("id", normalize_key(F.col("gabarito"), F.col("tipo")).alias("gabarito"), F.coalesce("topico", F.lit("Geral")).alias("topico"))
    gone = q.where("id % 10 = 3").select("id", F.lit(False).alias("ativa"))
    return H.overlay(H.overlay(q, changes, "id"), gone, "id").drop("tipo")


_PROP = f"p AS (SELECT registro_id, sha256(registro) AS chave, arquivo, row_number() OVER (PARTITION BY sha256(registro) ORDER BY registro_id) AS k FROM importacoes_brutas)"


@query(f"WITH {_PROP} SELECT chave, arquivo, registro_id, 'pendente' AS estado FROM p WHERE k = 1 ORDER BY arquivo, registro_id")
def proposal_staging(spark, d):
    """Proposals staged by the digest of their content: staging twice adds nothing."""
    p = table(spark, d, "importacoes_brutas").select(F.sha2("registro", 256).alias("chave"), "arquivo", "registro_id", F.lit("pendente").alias("estado"))
    first = p.groupBy("chave").agg(F.min_by(F.struct("arquivo", "registro_id", "estado"), "registro_id").alias("r")).select("chave", "r.*")
    return H.insert_or_ignore(first, first, "chave").orderBy("arquivo", "registro_id")


def _raw_fields(spark, d):
    r = table(spark, d, "importacoes_brutas")
    f = F.from_json(F.col("registro"), "map<string,string>")
    low = F.map_from_entries(F.transform(F.map_entries(f), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return r.select("registro_id", low.alias("m")).select("registro_id", *[F.col("m")[c].alias(c) for c in ("enunciado", "banca", "ano", "cargo")])


_CMP = r"trim(regexp_replace(replace(lower(regexp_replace({}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_KEYED = "(SELECT registro_id, map_from_entries(list_transform(json_keys(registro), lambda k: {'k': lower(k), 'v': json_extract_string(registro, '$.\"' || k || '\"')})) AS m FROM importacoes_brutas)"


@query(f"""WITH r AS (SELECT registro_id, m['enunciado'] AS enunciado, m['banca'] AS banca, m['ano'] AS ano, m['cargo'] AS cargo FROM {_KEYED}),
a AS (SELECT *, string_split({_CMP.format('enunciado')}, ' ') AS w FROM r WHERE enunciado IS NOT NULL), k AS (SELECT *, array_to_string(w[1:14], ' ') AS k FROM a WHERE len(w) >= 14),
n AS (SELECT k, min(registro_id) AS primeiro FROM k GROUP BY 1)
SELECT k.registro_id, n.primeiro, array_to_string(list_filter([CASE WHEN coalesce(q.banca,'') <> coalesce(k.banca,'') THEN 'banca=' || coalesce(q.banca,'') || '>' || coalesce(k.banca,'') END,
 CASE WHEN coalesce(q.ano,'') <> coalesce(k.ano,'') THEN 'ano=' || coalesce(q.ano,'') || '>' || coalesce(k.ano,'') END, CASE WHEN coalesce(q.cargo,'') <> coalesce(k.cargo,'') THEN 'cargo=' || coalesce(q.cargo,'') || '>' || coalesce(k.cargo,'') END], lambda x: x IS NOT NULL), '; ') AS diferencas
FROM k JOIN n USING (k) JOIN r q ON q.registro_id = n.primeiro WHERE k.registro_id <> n.primeiro""")
def reimport_diff(spark, d):
    """What each raw record changes in the first record of the same beginning."""
    raw = _raw_fields(spark, d)
    a = anchors(raw.where("enunciado IS NOT NULL"), "registro_id", "enunciado", 14)
    first = a.groupBy("ancora").agg(F.min("id").alias("primeiro"))
    m = a.join(first, "ancora").where("id <> primeiro").select(F.col("id").alias("registro_id"), "primeiro")
    fields = ("banca", "ano", "cargo")
    j = m.join(raw.select("registro_id", *[F.col(c).alias(f"b_{c}") for c in fields]), "registro_id")
    j = j.join(raw.select(F.col("registro_id").alias("primeiro"), *[F.col(c).alias(f"a_{c}") for c in fields]), "primeiro")
    return H.field_differences(j, list(fields), "a_", "b_").select("registro_id", "primeiro", "diferencas")


@query("""WITH n AS (SELECT id + 1000 AS novo, documento_fonte_questoes_id AS a, documento_fonte_gabarito_id AS b FROM provas_cadastradas WHERE id % 2 = 1)
SELECT n.novo, p.id AS existente FROM n LEFT JOIN provas_cadastradas p ON p.documento_fonte_questoes_id = n.a AND p.documento_fonte_gabarito_id IS NOT DISTINCT FROM n.b""")
def import_identity_match(spark, d):
    """Exams imported again from the same two sources reuse the one there is; a missing key source equals a missing one."""
    p = table(spark, d, "provas_cadastradas").select("id", F.col("documento_fonte_questoes_id").alias("a"), F.col("documento_fonte_gabarito_id").alias("b"))
    n = p.where("id % 2 = 1").select((F.col("id") + 1000).alias("novo"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return n.join(p, (F.col("a") == F.col("a2")) & F.col("b").eqNullSafe(F.col("b2")), "left").select("novo", F.col("id").alias("existente"))


@query(f"""WITH c AS (SELECT id AS questao_id, {_HASH} AS h FROM questoes), p AS (SELECT questao_id, CASE WHEN questao_id % 7 = 0 THEN 'outro' ELSE h END AS e FROM c WHERE questao_id % 2 = 0 UNION ALL SELECT questao_id, h FROM c WHERE questao_id % 12 = 0 UNION ALL SELECT -1, 'x')
SELECT p.questao_id, p.e AS hash_esperado, CASE WHEN c.h IS NULL THEN 'ausente' WHEN count(*) OVER (PARTITION BY p.questao_id) > 1 THEN 'concorrente' WHEN c.h <> p.e THEN 'alterada' ELSE 'aplicada' END AS resultado FROM p LEFT JOIN c USING (questao_id)""")
def apply_if_unchanged(spark, d):
    """Proposals applied only where the content they were made for is still there."""
    c = _current(spark, d)
    p = c.where("questao_id % 2 = 0").select("questao_id", F.when(F.col("questao_id") % 7 == 0, "outro").otherwise(F.col("hash_conteudo")).alias("hash_esperado"))
    p = p.unionByName(c.where("questao_id % 12 = 0").withColumnRenamed("hash_conteudo", "hash_esperado"))
    p = p.unionByName(spark.sql("SELECT -1L AS questao_id, 'x' AS hash_esperado"))
    return H.apply_if_unchanged(p, c, "questao_id")
