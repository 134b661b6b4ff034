"""Queries over curated examples and evaluation. An example is a question with an image; its group is its exam, its source the document of that."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions.keys import normalize_key
from quaestio.operators import curation as U
from quaestio.plans.registry import Registry
from quaestio.plans.sql import key_sql
from quaestio.session import table

query = Registry()
_EX = """x AS (SELECT q.id, 'img-' || (q.id % 211) AS imagem, l.grupo, l.fonte, q.tipo AS rotulo FROM questoes q
LEFT JOIN (SELECT l.questao_id, p.id AS grupo, p.documento_fonte_questoes_id AS fonte FROM prova_cadastrada_questoes l JOIN provas_cadastradas p ON p.id = l.prova_cadastrada_id) l ON l.questao_id = q.id)"""


def _examples(spark, d):
    p = table(spark, d, "provas_cadastradas").select(F.col("id").alias("grupo"), F.col("documento_fonte_questoes_id").alias("fonte"))
    l = table(spark, d, "prova_cadastrada_questoes").select(F.col("questao_id").alias("id"), F.col("prova_cadastrada_id").alias("grupo")).join(p, "grupo")  # noqa: E741
    q = table(spark, d, "questoes").select("id", F.col("tipo").alias("rotulo")).join(l, "id", "left")
    return q.select("id", F.concat(F.lit("img-"), (F.col("id") % 211).cast("string")).alias("imagem"), "grupo", "fonte", "rotulo")


@query(f"WITH {_EX} SELECT imagem, min(rotulo) AS rotulo, array_to_string(list_sort(list_distinct(list(grupo) FILTER (grupo IS NOT NULL))), ',') AS grupos, CASE WHEN min(rotulo) = max(rotulo) THEN 'ok' ELSE 'conflito' END AS situacao FROM x GROUP BY 1")
def lineage_merge(spark, d):
    """One row an image with all its groups; images with two labels are told."""
    m = U.merge_lineage(_examples(spark, d), "imagem", "rotulo")
    return m.select("imagem", "rotulo", F.when(F.size("grupos") > 0, F.array_join(F.transform("grupos", lambda g: g.cast("string")), ",")).alias("grupos"), "situacao")


_COMP = f"""WITH RECURSIVE {_EX}, k AS (SELECT id, 'g' || grupo AS k FROM x WHERE grupo IS NOT NULL UNION ALL SELECT id, 'f' || fonte FROM x WHERE fonte IS NOT NULL),
f AS (SELECT k, min(id) AS a FROM k GROUP BY 1), e AS (SELECT DISTINCT a AS u, id AS v FROM k JOIN f USING (k) WHERE a <> id), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT id AS n, id AS c FROM x UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.n AND r.c < s.v), m AS (SELECT n AS id, min(c) AS componente FROM r GROUP BY 1),
o AS (SELECT componente, row_number() OVER (ORDER BY componente) - 1 AS k FROM (SELECT DISTINCT componente FROM m)),
z AS (SELECT m.id, m.componente, CASE WHEN o.k % 5 = 0 THEN 'validacao' ELSE 'treino' END AS particao FROM m JOIN o USING (componente))"""


@query(f"{_COMP} SELECT * FROM z")
def components_split(spark, d):
    """Training and validation parts that share no group and no source."""
    return U.split(_examples(spark, d), "id", ["grupo", "fonte"])


@query(f"{_COMP} SELECT particao, count(*) AS n, count(DISTINCT componente) AS n_componentes, count(DISTINCT grupo) AS n_grupos, count(DISTINCT fonte) AS n_fontes FROM z JOIN x USING (id) GROUP BY 1")
def split_readiness(spark, d):
    """Size of each part."""
    x = _examples(spark, d)
    j = U.split(x, "id", ["grupo", "fonte"]).join(x.select("id", "grupo", "fonte"), "id")
    return j.groupBy("particao").agg(F.countDistinct("id").alias("n"), *[F.countDistinct(c).alias(a) for c, a in (("componente", "n_componentes"), ("grupo", "n_grupos"), ("fonte", "n_fontes"))])


@query(f"{_COMP}, y AS (SELECT * FROM z JOIN x USING (id)) SELECT 'grupo' AS chave, count(*) AS n FROM (SELECT grupo FROM y WHERE grupo IS NOT NULL GROUP BY 1 HAVING count(DISTINCT particao) > 1) UNION ALL SELECT 'fonte', count(*) FROM (SELECT fonte FROM y WHERE fonte IS NOT NULL GROUP BY 1 HAVING count(DISTINCT particao) > 1)")
def split_leaks(spark, d):
    """Key values that stand in both parts: none."""
    x = _examples(spark, d)
    j = U.split(x, "id", ["grupo", "fonte"]).join(x, "id")
    both = [j.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("particao").alias("k")).agg(F.lit(c).alias("chave"), F.count_if(F.col("k") > 1).alias("n")) for c in ("grupo", "fonte")]
    return both[0].unionByName(both[1])


@query(f"{_COMP}, l AS (SELECT particao, sha256('{{\"id\":' || id || ',\"rotulo\":\"' || rotulo || '\"}}') AS h FROM z JOIN x USING (id)) SELECT particao, count(*) AS linhas, CAST(sum(('0x' || substr(h, 1, 12))::BIGINT) AS VARCHAR) AS digesto FROM l GROUP BY 1")
def export_manifest(spark, d):
    """The manifest of an export as JSON lines: lines of each part and a digest of them that no order changes."""
    x = _examples(spark, d)
    j = U.split(x, "id", ["grupo", "fonte"]).join(x.select("id", "rotulo").distinct(), "id").select("particao", F.sha2(F.to_json(F.struct("id", "rotulo")), 256).alias("h"))
    digest = F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return j.groupBy("particao").agg(F.count("*").alias("linhas"), digest.alias("digesto"))


def _readings(spark, d):
    """Three readings of a stem: with wider blanks, as stored, and with something added for some; a tenth is not located."""
    i, t = F.col("id"), F.col("enunciado")
    a, b = F.when(i % 3 == 0, F.concat(t, F.lit(" x"))).otherwise(F.replace(t, F.lit(" "), F.lit("  "))), F.when(i % 4 == 0, F.concat(t, F.lit(" y"))).otherwise(t)
    return table(spark, d, "questoes").select("id", t.alias("atual"), a.alias("a"), b.alias("b"), F.when(i % 5 != 0, F.concat(t, F.lit(" x"))).alias("c"), (i % 10 != 0).alias("ok"))


_S = r"trim(regexp_replace(replace(lower(regexp_replace({}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH r AS (SELECT id, {_S.format('enunciado')} AS t, {_S.format("CASE WHEN id % 3 = 0 THEN enunciado || ' x' ELSE replace(enunciado, ' ', '  ') END")} AS a, {_S.format("CASE WHEN id % 4 = 0 THEN enunciado || ' y' ELSE enunciado END")} AS b, {_S.format("CASE WHEN id % 5 <> 0 THEN enunciado || ' x' END")} AS c, id % 10 <> 0 AS ok FROM questoes)
SELECT id, CASE WHEN NOT ok THEN 'abster' WHEN a = b THEN CASE WHEN a = t THEN 'manter' ELSE 'proposta' END WHEN c IS NULL THEN 'abster' WHEN c = a OR c = b THEN CASE WHEN c = t THEN 'manter' ELSE 'proposta' END ELSE 'divergencia' END AS decisao FROM r""")
def reader_consensus(spark, d):
    """What three readings of a stem agree on."""
    r = _readings(spark, d)
    decision, _ = U.consensus(F.col("a"), F.col("b"), F.col("c"), F.col("atual"), F.col("ok"))
    return r.select("id", decision.alias("decisao"))


_PRED = f"""v AS (SELECT questao_id, {key_sql('resposta_marcada', 'NULL')} AS r, count(*) AS n FROM (SELECT DISTINCT * FROM respostas) WHERE resposta_marcada IS NOT NULL GROUP BY 1, 2),
m AS (SELECT questao_id, r AS previsto FROM (SELECT *, row_number() OVER (PARTITION BY questao_id ORDER BY n DESC, r DESC) AS k FROM v WHERE r IS NOT NULL) WHERE k = 1),
g AS (SELECT q.orgao, m.previsto, {key_sql('q.gabarito', 'q.tipo')} AS ouro FROM questoes q LEFT JOIN m ON m.questao_id = q.id WHERE q.tipo = 'multipla_escolha' AND q.orgao IS NOT NULL AND {key_sql('q.gabarito', 'q.tipo')} IS NOT NULL)"""


@query(f"WITH {_PRED} SELECT orgao, count(*) AS n, count(previsto) AS previstas, count(*) FILTER (previsto = ouro) AS corretas, round(CASE WHEN count(previsto) > 0 THEN count(*) FILTER (previsto = ouro) / count(previsto) ELSE 0 END, 6) AS precisao, round(count(previsto) / count(*), 6) AS cobertura FROM g GROUP BY ROLLUP (orgao)")
def precision_vs_gold(spark, d):
    """The most frequent response of each question against its key: precision and coverage by agency and in all."""
    r = table(spark, d, "respostas").dropDuplicates(["id"]).where("resposta_marcada IS NOT NULL").select("questao_id", normalize_key(F.col("resposta_marcada"), F.lit(None)).alias("r"))
    n = r.where("r IS NOT NULL").groupBy("questao_id", "r").agg(F.count("*").alias("n"))
    m = n.groupBy(F.col("questao_id").alias("id")).agg(F.max(F.struct("n", "r")).alias("m")).select("id", F.col("m.r").alias("previsto"))
    q = table(spark, d, "questoes").where("tipo = 'multipla_escolha' AND orgao IS NOT NULL").select("id", "orgao", normalize_key(F.col("gabarito"), F.col("tipo")).alias("ouro"))
    return U.precision_report(q.where("ouro IS NOT NULL").join(m, "id", "left"), "orgao", "previsto", "ouro")
