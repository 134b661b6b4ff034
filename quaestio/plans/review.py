"""Queries over evidence, review, staging, scope and composition.

What people supply, such as evidence, decisions and choices, isn't among the tables; it is made from them by
rules of ids and orders, which the SQL repeats, over all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions.keys import normalize_key
from quaestio.operators import exams as E
from quaestio.operators import history as H
from quaestio.operators import review as V
from quaestio.plans import bank, curation
from quaestio.plans.history import _KEYED, _raw_fields
from quaestio.plans.registry import Registry
from quaestio.plans.sql import key_sql
from quaestio.session import table

query = Registry()


def _links(spark, d):
    return table(spark, d, "prova_cadastrada_questoes").select(F.col("prova_cadastrada_id").alias("prova_id"), "questao_id", "ordem")


# ---- composition and attempts


@query("""SELECT l.prova_cadastrada_id AS prova_id, l.ordem, q.id AS questao_id, CASE WHEN q.id % 5 = 0 THEN 'v1 ' || q.enunciado ELSE q.enunciado END AS enunciado,
CASE WHEN q.id % 5 <> 0 THEN q.gabarito END AS gabarito, q.tipo, q.id % 5 <> 0 AS sem_snapshot FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id""")
def exam_composition(spark, d):
    """Items of exams in order with the content they were pinned with; every fifth question has a snapshot without a key."""
    q = table(spark, d, "questoes")
    old = F.to_json(F.struct(F.concat(F.lit("v1 "), "enunciado").alias("enunciado"), F.lit(None).cast("string").alias("gabarito")), {"ignoreNullFields": "false"})
    return E.composition(_links(spark, d), q, q.where("id % 5 = 0").select(F.col("id").alias("questao_id"), old.alias("conteudo")), ["enunciado", "gabarito", "tipo"])


_ITEMS = "i0 AS (SELECT DISTINCT t.prova_id, r.questao_id FROM respostas r JOIN tentativas t ON t.id = r.tentativa_id WHERE t.prova_id IS NOT NULL AND t.finalizada_em IS NOT NULL)"


@query(f"""WITH {_ITEMS}, i AS (SELECT i0.*, q.tipo, {key_sql('q.gabarito', 'q.tipo')} AS c, coalesce({key_sql('q.gabarito', 'q.tipo')} <> 'Anulada', true) AS vale FROM i0 JOIN questoes q ON q.id = i0.questao_id),
t AS (SELECT prova_id, count(*) FILTER (vale) AS total FROM i GROUP BY 1), a AS (SELECT x.id AS tentativa_id, x.prova_id, t.total FROM tentativas x JOIN t ON t.prova_id = x.prova_id),
r AS (SELECT tentativa_id, questao_id, resposta_marcada AS m FROM (SELECT *, row_number() OVER (PARTITION BY tentativa_id, questao_id ORDER BY id DESC) AS k FROM (SELECT DISTINCT * FROM respostas)) WHERE k = 1),
s AS (SELECT r.tentativa_id, count(*) FILTER (i.vale AND {key_sql('r.m', 'i.tipo')} = i.c) AS acertos, count(*) FILTER (i.vale IS NULL) AS alheias FROM r JOIN a USING (tentativa_id) LEFT JOIN i ON i.prova_id = a.prova_id AND i.questao_id = r.questao_id GROUP BY 1)
SELECT a.tentativa_id, a.total, coalesce(s.acertos, 0) AS acertos, coalesce(s.alheias, 0) AS alheias, round(CASE WHEN total > 0 THEN coalesce(acertos, 0) / total * 100 ELSE 0 END, 6) AS nota FROM a LEFT JOIN s USING (tentativa_id)""")
def attempt_scoring_composed(spark, d):
    """Attempts marked against the whole exam: its items are the questions that finished attempts at it hold."""
    t = table(spark, d, "tentativas").where("prova_id IS NOT NULL")
    done = t.where("finalizada_em IS NOT NULL").select(F.col("id").alias("tentativa_id"), "prova_id")
    r = table(spark, d, "respostas")
    items = r.select("tentativa_id", "questao_id").join(done, "tentativa_id").select("prova_id", "questao_id").distinct()
    composed = items.join(table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "tipo", "gabarito"), "questao_id")
    return E.scored_by_composition(t, r, composed)


@query("""WITH t AS (SELECT prova_id, bool_or(finalizada_em IS NOT NULL) AS f, min(id) FILTER (finalizada_em IS NULL) AS aberta FROM tentativas GROUP BY 1),
i AS (SELECT l.prova_cadastrada_id AS prova_id, count(*) AS n, count(*) FILTER (NOT coalesce(q.ativa AND q.gabarito IS NOT NULL, false)) AS fora FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id GROUP BY 1),
x AS (SELECT p.id AS prova_id, CASE WHEN f THEN 'finalizada' WHEN aberta IS NOT NULL THEN 'reaberta' WHEN coalesce(n, 0) = 0 THEN 'vazia' WHEN fora > 0 THEN 'indisponivel' ELSE 'nova' END AS decisao, aberta, fora FROM provas p LEFT JOIN t ON t.prova_id = p.id LEFT JOIN i ON i.prova_id = p.id)
SELECT prova_id, decisao, CASE WHEN decisao = 'reaberta' THEN aberta END AS tentativa_id, CASE WHEN decisao = 'indisponivel' THEN fora END AS indisponiveis FROM x""")
def attempt_start(spark, d):
    """What starting an attempt at each mock exam does; its items are those of the imported exam of the same id."""
    ok = (F.col("ativa") & F.col("gabarito").isNotNull()).alias("liberada")
    items = _links(spark, d).join(table(spark, d, "questoes").select(F.col("id").alias("questao_id"), ok), "questao_id")
    return E.attempt_start(table(spark, d, "provas"), table(spark, d, "tentativas"), items)


@query(f"""WITH r AS (SELECT registro_id, m['enunciado'] AS enunciado, CASE WHEN registro_id % 2 = 0 THEN 'multipla_escolha' ELSE 'certo_errado' END AS tipo FROM {_KEYED})
SELECT (SELECT max(id) FROM questoes) + row_number() OVER (ORDER BY registro_id) AS questao_id, CASE WHEN tipo = 'multipla_escolha' THEN 2 ELSE 0 END AS n_opcoes, 1 AS numero_versao,
sha256(to_json({{'enunciado': enunciado, 'tipo': tipo}})) AS hash_conteudo FROM r WHERE trim(enunciado) <> ''""")
def question_insert(spark, d):
    """Raw records inserted as one batch of questions, with two options where they have any, and their first versions."""
    raw = _raw_fields(spark, d).where("trim(enunciado) <> ''")
    new = raw.select(F.col("registro_id").alias("ref"), "enunciado", F.when(F.col("registro_id") % 2 == 0, "multipla_escolha").otherwise("certo_errado").alias("tipo"))
    options = new.select("ref", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("letra"), F.lit("x").alias("texto"))
    after = table(spark, d, "questoes").agg(F.max("id")).first()[0] or 0
    _, o, v = H.insert_questions(new, options, ["enunciado", "tipo"], after)
    n = o.groupBy("questao_id").agg(F.count("*").cast("int").alias("n"))
    return v.join(n, "questao_id", "left").select("questao_id", F.coalesce("n", F.lit(0)).alias("n_opcoes"), "numero_versao", "hash_conteudo")


# ---- evidence

_EV = """e0 AS (SELECT l.questao_id, l.ordem, p.id AS pid, p.nome, b.cargo AS bc, b.identificacao_prova AS bi, b.versao AS bv, k.cargo AS kc, k.identificacao_prova AS ki, k.versao AS kv FROM prova_cadastrada_questoes l JOIN provas_cadastradas p ON p.id = l.prova_cadastrada_id
 LEFT JOIN documentos_fonte b ON b.id = p.documento_fonte_questoes_id LEFT JOIN documentos_fonte k ON k.id = p.documento_fonte_gabarito_id),
e1 AS (SELECT questao_id * 2 AS id, questao_id, 'conteudo' AS parte, ordem // 5 + CASE WHEN ordem % 41 = 0 THEN -99 ELSE 1 END AS pagina, CASE WHEN ordem % 7 = 0 THEN 45 ELSE 0 END AS rotacao, CASE WHEN ordem % 19 = 0 THEN 'NaN'::DOUBLE ELSE 10.0 END AS x0, ((ordem % 5) * 100)::DOUBLE AS y0,
 CASE WHEN ordem % 11 = 0 THEN 10.0 ELSE 500.0 END::DOUBLE AS x1, ((ordem % 5) * 100 + 90)::DOUBLE AS y1, 595.0::DOUBLE AS largura, CASE WHEN ordem % 13 = 0 THEN 400.0 WHEN ordem % 17 = 0 THEN 0.0 ELSE 842.0 END::DOUBLE AS altura, nome AS prova,
 CASE WHEN pid % 2 = 0 THEN coalesce(bc, 'unico') ELSE bc END AS cargo, CASE WHEN pid % 2 = 0 THEN coalesce(bi, 'unico') ELSE bi END AS codigo, CASE WHEN pid % 2 = 0 THEN coalesce(bv, 'unico') ELSE bv END AS versao, NULL AS situacao, ordem FROM e0
 UNION ALL SELECT questao_id * 2 + 1, questao_id, CASE WHEN ordem % 23 = 0 THEN 'outra' ELSE 'gabarito' END, 1, NULL, 10.0, ordem::DOUBLE, 90.0, (ordem + 5)::DOUBLE, 595.0, 842.0, nome, CASE WHEN pid % 2 = 0 THEN coalesce(kc, 'unico') ELSE kc END, CASE WHEN pid % 2 = 0 THEN coalesce(ki, 'unico') ELSE ki END,
 CASE WHEN pid % 2 = 0 THEN coalesce(kv, 'unico') ELSE kv END, CASE WHEN ordem % 3 > 0 THEN 'definitivo' END, ordem FROM e0),
e AS (SELECT * EXCLUDE ordem FROM e1 UNION ALL SELECT id + 1000000000, * EXCLUDE (id, ordem) FROM e1 WHERE ordem % 4 = 0)"""
_ERR = f"""x AS (SELECT *, CASE WHEN parte NOT IN {V.PARTS} THEN 'parte_invalida' WHEN trim(coalesce(prova,'')) = '' OR trim(coalesce(cargo,'')) = '' OR trim(coalesce(codigo,'')) = '' OR trim(coalesce(versao,'')) = '' THEN 'escopo_incompleto'
 WHEN parte = 'gabarito' AND coalesce(situacao, '') NOT IN {V.KEY_STATES} THEN 'situacao_ausente' WHEN pagina IS NULL OR pagina < 1 THEN 'pagina_invalida' WHEN coalesce(rotacao, 0) NOT IN (0, 90, 180, 270) THEN 'rotacao_invalida'
 WHEN isnan(x0) OR isnan(y0) OR isnan(x1) OR isnan(y1) THEN 'coordenadas_invalidas' WHEN x0 < 0 OR y0 < 0 OR x1 <= x0 OR y1 <= y0 THEN 'regiao_invalida' WHEN NOT (largura > 0 AND altura > 0) THEN 'pagina_sem_dimensoes' WHEN x1 > largura OR y1 > altura THEN 'regiao_fora_da_pagina' END AS erro FROM e)"""


def _evidence(spark, d):
    docs = table(spark, d, "documentos_fonte")
    side = lambda x: docs.select(F.col("id").alias(f"{x}id"), F.col("cargo").alias(f"{x}c"), F.col("identificacao_prova").alias(f"{x}i"), F.col("versao").alias(f"{x}v"))
    p = table(spark, d, "provas_cadastradas").select(F.col("id").alias("prova_id"), "nome", F.col("documento_fonte_questoes_id").alias("bid"), F.col("documento_fonte_gabarito_id").alias("kid"))
    e = _links(spark, d).join(p.join(side("b"), "bid", "left").join(side("k"), "kid", "left"), "prova_id")
    o = F.col("ordem")
    given = lambda c, as_: F.when(F.col("prova_id") % 2 == 0, F.coalesce(c, F.lit("unico"))).otherwise(F.col(c)).alias(as_)
    dbl = lambda c, as_: c.cast("double").alias(as_)
    content = e.select(
        (F.col("questao_id") * 2).alias("id"), "questao_id", F.lit("conteudo").alias("parte"), (F.floor(o / 5) + F.when(o % 41 == 0, -99).otherwise(1)).cast("int").alias("pagina"), F.when(o % 7 == 0, 45).otherwise(0).alias("rotacao"),
        dbl(F.when(o % 19 == 0, float("nan")).otherwise(10.0), "x0"), dbl((o % 5) * 100, "y0"), dbl(F.when(o % 11 == 0, 10.0).otherwise(500.0), "x1"), dbl((o % 5) * 100 + 90, "y1"), dbl(F.lit(595), "largura"),
        dbl(F.when(o % 13 == 0, 400).when(o % 17 == 0, 0).otherwise(842), "altura"), F.col("nome").alias("prova"), given("bc", "cargo"), given("bi", "codigo"), given("bv", "versao"), F.lit(None).cast("string").alias("situacao"), "ordem",
    )
    keys = e.select(
        (F.col("questao_id") * 2 + 1).alias("id"), "questao_id", F.when(o % 23 == 0, "outra").otherwise("gabarito").alias("parte"), F.lit(1).alias("pagina"), F.lit(None).cast("int").alias("rotacao"), dbl(F.lit(10), "x0"), dbl(o, "y0"), dbl(F.lit(90), "x1"),
        dbl(o + 5, "y1"), dbl(F.lit(595), "largura"), dbl(F.lit(842), "altura"), F.col("nome").alias("prova"), given("kc", "cargo"), given("ki", "codigo"), given("kv", "versao"), F.when(o % 3 > 0, "definitivo").alias("situacao"), "ordem",
    )
    both = content.unionByName(keys)
    return both.unionByName(both.where(o % 4 == 0).withColumn("id", F.col("id") + 1000000000)).drop("ordem")


@query(f"WITH {_EV}, {_ERR} SELECT id, erro FROM x")
def evidence_errors(spark, d):
    """Why each row of evidence is refused, or null."""
    return _evidence(spark, d).select("id", V.evidence_error().alias("erro"))


@query(f"""WITH {_EV}, {_ERR}, k AS (SELECT *, row_number() OVER (PARTITION BY questao_id, parte, pagina, x0, y0, x1, y1, prova, cargo, codigo, versao ORDER BY id) AS k FROM x WHERE erro IS NULL)
SELECT questao_id, CASE WHEN bool_or(parte <> 'gabarito') THEN 'pendente' END AS revisao_conteudo, CASE WHEN bool_or(parte = 'gabarito') THEN 'desconhecido' END AS revisao_gabarito FROM k WHERE k = 1 GROUP BY 1""")
def evidence_resets(spark, d):
    """The reviews that new evidence reopens; repeated evidence counts once."""
    return V.append_evidence(_evidence(spark, d), "questao_id", "id")[1]


@query(f"""WITH {_EV}, {_ERR} SELECT a.questao_id, a.id AS a, b.id AS b FROM x a JOIN x b ON b.questao_id = a.questao_id AND a.parte = 'conteudo' AND b.parte = 'gabarito' AND a.prova IS NOT DISTINCT FROM b.prova
AND a.cargo IS NOT DISTINCT FROM b.cargo AND a.codigo IS NOT DISTINCT FROM b.codigo AND a.versao IS NOT DISTINCT FROM b.versao""")
def evidence_scope_agreement(spark, d):
    """Evidence of content and of the key of one question whose scopes agree."""
    e = _evidence(spark, d)
    return V.same_scope(e.where("parte = 'conteudo'"), e.where("parte = 'gabarito'"), "questao_id", "id")


@query(f"""WITH {_EV}, g AS (SELECT id AS diagnostico, CASE WHEN id % 2 = 0 THEN 'gabarito' ELSE 'conteudo' END AS parte, CASE WHEN id % 3 = 0 THEN id * 2 + 1 END AS listada FROM questoes),
m AS (SELECT g.diagnostico, e.id, CASE WHEN e.id = g.listada THEN 0 WHEN e.parte = g.parte THEN 1 END AS r FROM g LEFT JOIN e ON e.questao_id = g.diagnostico)
SELECT diagnostico, min_by(id, r * 10000000000 + id) FILTER (r IS NOT NULL) AS evidencia FROM m GROUP BY 1""")
def evidence_first_match(spark, d):
    """The evidence to show for a diagnostic of each question: the first it lists, else the first of its part."""
    i = F.col("id")
    ids = F.when(i % 3 == 0, F.array(i * 2 + 1)).otherwise(F.array().cast("array<bigint>"))
    g = table(spark, d, "questoes").select(i.alias("diagnostico"), i.alias("questao_id"), F.when(i % 2 == 0, "gabarito").otherwise("conteudo").alias("parte"), ids.alias("ids"))
    return V.first_match(g, _evidence(spark, d), "questao_id")


# ---- staging, sources, scope


@query("""WITH p AS (SELECT sha256(registro) AS chave, CASE WHEN min(registro_id) % 5 = 0 THEN 'aplicada' ELSE 'pendente' END AS estado FROM importacoes_brutas GROUP BY 1),
d AS (SELECT CASE WHEN registro_id % 17 = 0 THEN 'x' || registro_id ELSE sha256(registro) END AS chave, CASE WHEN registro_id % 9 = 0 THEN 'talvez' WHEN registro_id % 2 = 0 THEN 'aprovada' ELSE 'rejeitada' END AS decisao, CASE WHEN registro_id % 10 = 0 THEN ' ' ELSE 'r' END AS responsavel FROM importacoes_brutas),
j AS (SELECT d.*, p.estado, count(*) OVER (PARTITION BY d.chave) > 1 AS varias FROM d LEFT JOIN p USING (chave)),
r AS (SELECT *, CASE WHEN decisao NOT IN ('aprovada', 'rejeitada') OR trim(responsavel) = '' THEN 'recusada' WHEN estado IS NULL THEN 'inexistente' WHEN varias THEN 'concorrente' WHEN estado <> 'pendente' THEN 'ja_decidida' ELSE 'registrada' END AS resultado FROM j)
SELECT chave, CASE WHEN resultado = 'registrada' THEN decisao ELSE estado END AS estado, resultado FROM r""")
def staging_decisions(spark, d):
    """Decisions on staged proposals: only pending ones change, and only once."""
    r, i = table(spark, d, "importacoes_brutas"), F.col("registro_id")
    key = F.sha2("registro", 256)
    p = r.groupBy(key.alias("chave")).agg(F.when(F.min("registro_id") % 5 == 0, "aplicada").otherwise("pendente").alias("estado"))
    what = F.when(i % 9 == 0, "talvez").when(i % 2 == 0, "aprovada").otherwise("rejeitada")
    n = r.select(F.when(i % 17 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(key).alias("chave"), what.alias("decisao"), F.when(i % 10 == 0, " ").otherwise("r").alias("responsavel"), F.lit("j").alias("justificativa"))
    return V.decide(p, n)


@query("""WITH f AS (SELECT localizacao, min(CASE WHEN id % 9 = 0 THEN md5(localizacao) ELSE coalesce(sha256, 'abc') END) AS atual FROM documentos_fonte WHERE localizacao IS NOT NULL AND id % 6 <> 0 GROUP BY 1)
SELECT id, atual IS NOT NULL AS disponivel, coalesce(sha256 = atual, false) AS integro, CASE WHEN atual IS NULL THEN 'arquivo_ausente' WHEN sha256 IS NULL THEN 'hash_desconhecido' WHEN sha256 = atual THEN 'integro' ELSE 'hash_divergente' END AS motivo FROM documentos_fonte LEFT JOIN f USING (localizacao)""")
def source_integrity(spark, d):
    """Whether the file of each source is there and is the one registered; some have changed or gone."""
    s = table(spark, d, "documentos_fonte").select("id", "sha256", "localizacao")
    now = F.when(F.col("id") % 9 == 0, F.md5("localizacao")).otherwise(F.coalesce("sha256", F.lit("abc")))
    return V.integrity(s, s.where("localizacao IS NOT NULL AND id % 6 <> 0").groupBy("localizacao").agg(F.min(now).alias("sha256_atual")))


_NUM = "n AS (SELECT DISTINCT l.prova_cadastrada_id AS prova_id, q.numero_oficial AS numero FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id WHERE q.numero_oficial IS NOT NULL)"


@query(f"""WITH {_NUM}, i AS (SELECT id AS p, 'ancora_nao_encontrada:' || (id % 20 + 1) AS defeito, id % 20 + 1 AS k FROM provas_cadastradas UNION ALL SELECT id, 'marcador_duplicado:' || (id % 15 + 1), id % 15 + 1 FROM provas_cadastradas UNION ALL SELECT id, 'pagina_rotacionada:2', NULL FROM provas_cadastradas WHERE id % 3 = 0)
SELECT n.prova_id, n.numero, i.defeito FROM n JOIN i ON i.p = n.prova_id AND (i.k IS NULL OR i.k = n.numero)""")
def geometry_issues(spark, d):
    """Defects of a booklet's pages by question: numbered ones hold for one question."""
    q = table(spark, d, "questoes").where("numero_oficial IS NOT NULL").select(F.col("id").alias("questao_id"), F.col("numero_oficial").alias("numero"))
    n = _links(spark, d).join(q, "questao_id").select("prova_id", "numero").distinct()
    i = F.col("id")
    named = lambda t, k: F.concat(F.lit(f"{t}:"), (i % k + 1).cast("string"))
    said = F.array_compact(F.array(named("ancora_nao_encontrada", 20), named("marcador_duplicado", 15), F.when(i % 3 == 0, "pagina_rotacionada:2")))
    return V.issues_of_number(table(spark, d, "provas_cadastradas").select(i.alias("prova_id"), F.explode(said).alias("defeito")), n, "prova_id")


_META = """m AS (SELECT p.id, b.cargo AS ac, b.identificacao_prova AS ai, b.versao AS av, k.cargo AS kc, k.identificacao_prova AS ki, k.versao AS kv FROM provas_cadastradas p LEFT JOIN documentos_fonte b ON b.id = p.documento_fonte_questoes_id LEFT JOIN documentos_fonte k ON k.id = p.documento_fonte_gabarito_id)"""


def _meta(spark, d):
    docs = table(spark, d, "documentos_fonte")
    side = lambda x, key: docs.select(F.col("id").alias(key), *[F.array_compact(F.array(c)).alias(f"{x}_{n}") for c, n in (("cargo", "cargo"), ("identificacao_prova", "codigo"), ("versao", "versao"))])
    p = table(spark, d, "provas_cadastradas").select("id", F.col("documento_fonte_questoes_id").alias("bid"), F.col("documento_fonte_gabarito_id").alias("kid"))
    return p.join(side("a", "bid"), "bid", "left").join(side("b", "kid"), "kid", "left")


@query(f"WITH {_META} SELECT id, CASE WHEN ac = kc AND ai = ki AND av = kv THEN ac END AS escopo_cargo, CASE WHEN ac = kc AND ai = ki AND av = kv THEN ai END AS escopo_codigo, CASE WHEN ac = kc AND ai = ki AND av = kv THEN av END AS escopo_versao FROM m")
def scope_derivation(spark, d):
    """The scope that booklet and key of an exam have in common, where role, code and version each leave one value."""
    return V.derived_scope(_meta(spark, d), ("cargo", "codigo", "versao")).select("id", "escopo_cargo", "escopo_codigo", "escopo_versao")


@query(f"""WITH {_META}, c AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE kv END AS e, CASE WHEN kv IS NULL THEN 0 ELSE 1 END + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n, av FROM m)
SELECT id, CASE WHEN coalesce(e, '') = '' AND n > 1 THEN 'escolher' WHEN coalesce(e, '') <> '' AND av IS NOT NULL AND e <> av THEN 'divergente' END AS problema FROM c""")
def scope_selection(spark, d):
    """Whether the version chosen for each key can be taken: every second key offers one more, every third has none chosen."""
    m = _meta(spark, d)
    empty = F.array().cast("array<string>")
    have = F.coalesce("b_versao", empty)
    offered = F.when(F.col("id") % 2 == 0, F.array_append(have, F.lit("outra"))).otherwise(have)
    return m.select("id", V.scope_question(F.when(F.col("id") % 3 == 0, "").otherwise(F.get(have, F.lit(0))), offered, F.coalesce("a_versao", empty)).alias("problema"))


_BOARD = """b AS (SELECT l.prova_cadastrada_id AS doc, l.ordem AS numero, min(q.gabarito) AS g FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id WHERE q.gabarito IN ('A','B','C','D','E') GROUP BY 1, 2),
o AS (SELECT doc, numero, 1 AS pagina, 'r' || numero AS regiao, CASE WHEN doc % 5 = 0 AND numero % 10 = 0 THEN translate(g, 'ABCDE', 'BCDEA') ELSE g END AS resposta FROM b WHERE NOT (doc % 7 = 0 AND numero % 9 = 0)
 UNION ALL SELECT doc, numero, 2, 'r' || numero, g FROM b WHERE doc % 3 = 0 OR (doc % 3 = 1 AND numero % 2 = 0)), x AS (SELECT doc, numero, CASE WHEN numero % 4 <> 0 THEN g END AS esperada FROM b)"""


@query(f"""WITH {_BOARD}, pg AS (SELECT doc, pagina, string_agg(numero || resposta, ',' ORDER BY numero) AS quadro, count(*) AS n FROM o GROUP BY 1, 2), w AS (SELECT pg.*, count(*) OVER (PARTITION BY pg.doc, quadro) AS c FROM pg JOIN (SELECT doc, count(*) AS t FROM x GROUP BY 1) s ON s.doc = pg.doc AND s.t = pg.n),
p AS (SELECT o.doc, o.numero, min(o.resposta) AS a, max(o.resposta) AS z, count(*) AS k, bool_and(w.doc IS NOT NULL) AS copias FROM o LEFT JOIN w ON w.doc = o.doc AND w.pagina = o.pagina AND w.c > 1 GROUP BY 1, 2),
s AS (SELECT x.doc, x.numero, p.a, CASE WHEN p.a IS NULL THEN 'ausente' WHEN p.a <> p.z OR coalesce(x.esperada <> p.a, false) THEN 'conflito' WHEN p.k > 1 AND NOT copias THEN 'ambigua' WHEN p.k > 1 THEN 'duplicado_identico' ELSE 'encontrada' END AS situacao FROM x LEFT JOIN p USING (doc, numero))
SELECT doc, numero, CASE WHEN situacao IN ('encontrada', 'duplicado_identico') THEN a END AS resposta, situacao FROM s""")
def answer_evidence(spark, d):
    """Answers seen on the pages of a key, one board printed twice in some, half a board in others, with wrong and missing cells."""
    q = table(spark, d, "questoes").where(F.col("gabarito").isin(*"ABCDE")).select(F.col("id").alias("questao_id"), "gabarito")
    b = _links(spark, d).join(q, "questao_id").groupBy(F.col("prova_id").alias("doc"), F.col("ordem").alias("numero")).agg(F.min("gabarito").alias("g"))
    doc, n = F.col("doc"), F.col("numero")
    place = F.concat(F.lit("r"), n.cast("string")).alias("regiao")
    one = b.where(~((doc % 7 == 0) & (n % 9 == 0))).select("doc", "numero", F.lit(1).alias("pagina"), place, F.when((doc % 5 == 0) & (n % 10 == 0), F.translate("g", "ABCDE", "BCDEA")).otherwise(F.col("g")).alias("resposta"))
    two = b.where((doc % 3 == 0) | ((doc % 3 == 1) & (n % 2 == 0))).select("doc", "numero", F.lit(2).alias("pagina"), place, F.col("g").alias("resposta"))
    return V.answer_evidence(one.unionByName(two), b.select("doc", "numero", F.when(n % 4 != 0, F.col("g")).alias("esperada")), "doc")


# ---- diagnostics and reports

_SP = f"sp AS ({bank.query.sql['structure_problems']})"


def _problems(spark, d):
    return bank.structure_problems(spark, d).withColumn("codigos", F.when(F.col("problemas") != "", F.split("problemas", ",")).otherwise(F.array().cast("array<string>")))


@query(f"""WITH {_SP}, c AS (SELECT id, CASE WHEN problemas <> '' THEN string_split(problemas, ',') ELSE [] END AS c FROM sp)
SELECT 'etapa' AS tipo, coalesce(c[1], 'liberada') AS nome, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'motivo', m, count(*) FROM (SELECT unnest(c) AS m FROM c) GROUP BY 2""")
def funnel_histogram(spark, d):
    """How many questions stop at each stage, one each, and how many have each reason, which overlap."""
    p = _problems(spark, d)
    stage = p.groupBy(F.lit("etapa").alias("tipo"), F.coalesce(F.get("codigos", F.lit(0)), F.lit("liberada")).alias("nome")).agg(F.count("*").alias("n"))
    why = p.select(F.explode(F.array_distinct("codigos")).alias("nome")).groupBy(F.lit("motivo").alias("tipo"), "nome").agg(F.count("*").alias("n"))
    return stage.unionByName(why)


@query(f"""WITH {_SP}, c AS (SELECT id, unnest(string_split(problemas, ',')) AS codigo FROM sp WHERE problemas <> '')
SELECT id, codigo, CASE WHEN contains(codigo, 'numeracao') THEN 'numero_oficial' WHEN codigo IN ('alternativas_invalidas', 'alternativas_possivelmente_fundidas') THEN 'alternativas' WHEN contains(codigo, 'gabarito') OR id % 4 = 0 THEN 'gabarito' WHEN id % 4 = 1 THEN 'texto_apoio' ELSE 'enunciado' END AS campo FROM c""")
def diagnostic_targets(spark, d):
    """The field that each diagnostic of a question is about."""
    c = _problems(spark, d).select("id", F.explode("codigos").alias("codigo"))
    part = F.when(F.col("id") % 4 == 0, "gabarito").when(F.col("id") % 4 == 1, "contexto")
    return c.select("id", "codigo", V.diagnostic_target(F.col("codigo"), F.lit("estrutura"), part).alias("campo"))


@query(f"""WITH {_SP} SELECT l.prova_cadastrada_id AS prova_id, count(*) AS verificadas, count(*) FILTER (problemas = '') AS certificadas, sum(len(list_filter(CASE WHEN problemas <> '' THEN string_split(problemas, ',') ELSE [] END, lambda c: c <> 'rodape_misturado')))::BIGINT AS pendencias,
coalesce(string_agg(q.numero_oficial::VARCHAR, ',' ORDER BY q.numero_oficial) FILTER (problemas <> '' AND q.numero_oficial IS NOT NULL), '') AS pendentes FROM prova_cadastrada_questoes l JOIN sp ON sp.id = l.questao_id JOIN questoes q ON q.id = l.questao_id GROUP BY 1""")
def batch_verification(spark, d):
    """Totals of each import: verified and certified questions, diagnostics that aren't informative only, and the pending numbers."""
    p = _problems(spark, d).select(F.col("id").alias("questao_id"), "codigos")
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), F.col("numero_oficial").alias("numero"))
    bad = F.size("codigos") > 0
    g = _links(spark, d).join(p, "questao_id").join(q, "questao_id").groupBy("prova_id").agg(
        F.count("*").alias("verificadas"), F.count_if(~bad).alias("certificadas"), F.sum(F.size(F.filter("codigos", lambda c: c != "rodape_misturado"))).alias("pendencias"),
        F.array_sort(F.collect_list(F.when(bad, F.col("numero")))).alias("_p"),
    )
    return g.select("prova_id", "verificadas", "certificadas", "pendencias", F.array_join(F.col("_p").cast("array<string>"), ",").alias("pendentes"))


@query(f"""SELECT p.id, CASE WHEN p.id % 4 = 0 THEN 'não informadas' ELSE count(q.id)::VARCHAR END AS esperadas, count(q.id) AS extraidas, count(q.id) FILTER ({key_sql('q.gabarito', 'q.tipo')} IS NOT NULL) AS com_resposta, count(q.id) FILTER (q.ativa) AS salvas
FROM provas_cadastradas p LEFT JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = p.id LEFT JOIN questoes q ON q.id = l.questao_id GROUP BY 1""")
def import_summary(spark, d):
    """Expected, extracted, answered and saved questions of each import; every fourth one declares no number."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), normalize_key(F.col("gabarito"), F.col("tipo")).alias("k"), "ativa")
    per = _links(spark, d).join(q, "questao_id").groupBy(F.col("prova_id").alias("id")).agg(F.count("*").alias("n"), F.count("k").alias("c"), F.count_if("ativa").alias("s"))
    j = table(spark, d, "provas_cadastradas").select("id").join(per, "id", "left")
    n, c, s = (F.coalesce(x, F.lit(0)) for x in ("n", "c", "s"))
    return j.select("id", F.when(F.col("id") % 4 == 0, "não informadas").otherwise(n.cast("string")).alias("esperadas"), n.alias("extraidas"), c.alias("com_resposta"), s.alias("salvas"))


_CASES = f"""r AS ({curation.query.sql['reader_consensus']}), c AS (SELECT r.id, CASE WHEN r.id % 5 = 0 THEN 'avaliacao' ELSE 'ajuste' END AS particao, decisao AS obtido, CASE WHEN r.id % 2 = 0 THEN 'x' ELSE 'y' END AS proposta, CASE WHEN r.id % 7 = 0 THEN 'abster' WHEN r.id % 3 = 0 THEN 'proposta' ELSE 'manter' END AS esperado, CASE WHEN r.id % 4 < 2 THEN 'x' ELSE 'y' END AS texto FROM r)"""


def _cases(spark, d):
    i = F.col("id")
    return curation.reader_consensus(spark, d).select(
        "id", F.when(i % 5 == 0, "avaliacao").otherwise("ajuste").alias("particao"), F.col("decisao").alias("obtido"), F.when(i % 2 == 0, "x").otherwise("y").alias("proposta"),
        F.when(i % 7 == 0, "abster").when(i % 3 == 0, "proposta").otherwise("manter").alias("esperado"), F.when(i % 4 < 2, "x").otherwise("y").alias("texto"),
    )


@query(f"""WITH {_CASES} SELECT particao, count(*) AS casos, count(*) FILTER (CASE WHEN esperado = 'proposta' THEN obtido = 'proposta' AND proposta = texto ELSE obtido = esperado END) AS corretos, count(*) FILTER (obtido = 'proposta' AND (esperado <> 'proposta' OR proposta <> texto)) AS propostas_erradas,
count(*) FILTER (esperado = 'abster') AS abstencoes_exigidas, count(*) FILTER (esperado = 'abster' AND obtido = 'abster') AS abstencoes_seguras, count(*) FILTER (obtido IN ('abster', 'divergencia') AND esperado <> 'abster') AS sem_solucao FROM c GROUP BY 1""")
def evaluator_summary(spark, d):
    """What an evaluation of the readers' consensus counts in each part."""
    return V.evaluation(_cases(spark, d), "particao")


@query(f"""WITH {_CASES}, k AS (SELECT c.particao, l.prova_cadastrada_id AS grupo, p.documento_fonte_questoes_id AS fonte FROM c JOIN prova_cadastrada_questoes l ON l.questao_id = c.id JOIN provas_cadastradas p ON p.id = l.prova_cadastrada_id)
SELECT 'grupo' AS chave, grupo::VARCHAR AS valor FROM k WHERE grupo IS NOT NULL GROUP BY 2 HAVING count(DISTINCT particao) > 1 UNION ALL SELECT 'fonte', fonte::VARCHAR FROM k WHERE fonte IS NOT NULL GROUP BY 2 HAVING count(DISTINCT particao) > 1""")
def evaluator_leaks(spark, d):
    """Exams and sources that stand in both parts of an evaluation, which would refuse it."""
    p = table(spark, d, "provas_cadastradas").select(F.col("id").alias("grupo"), F.col("documento_fonte_questoes_id").alias("fonte"))
    k = _links(spark, d).select(F.col("questao_id").alias("id"), F.col("prova_id").alias("grupo")).join(p, "grupo")
    return V.split_leak(_cases(spark, d).select("id", "particao").join(k, "id"), ["grupo", "fonte"], "particao")


@query("""WITH a AS (SELECT l.prova_cadastrada_id AS escopo, row_number() OVER (PARTITION BY l.prova_cadastrada_id ORDER BY coalesce(q.numero_oficial, 9999), q.id) AS posicao, q.gabarito AS previsto FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id),
b AS (SELECT l.prova_cadastrada_id AS escopo, row_number() OVER (PARTITION BY l.prova_cadastrada_id ORDER BY l.ordem, q.id) AS posicao, q.gabarito AS ouro FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id WHERE q.ativa)
SELECT coalesce(a.escopo, b.escopo) AS escopo, coalesce(a.posicao, b.posicao)::INTEGER AS posicao, previsto, ouro FROM a FULL JOIN b ON a.escopo = b.escopo AND a.posicao = b.posicao""")
def positional_match(spark, d):
    """Answers in the order of official numbers beside the active questions' in the order of the exam, place by place."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), F.coalesce("numero_oficial", F.lit(9999)).alias("numero"), "gabarito", "ativa")
    j = _links(spark, d).withColumnRenamed("prova_id", "escopo").join(q, "questao_id")
    a = j.select("escopo", "numero", F.col("questao_id").alias("i"), F.col("gabarito").alias("previsto"))
    b = j.where("ativa").select("escopo", "ordem", "questao_id", F.col("gabarito").alias("ouro"))
    return V.positional(a, b, "escopo", ["numero", "i"], ["ordem", "questao_id"])


@query("""WITH v AS (SELECT l.prova_cadastrada_id AS id, 'ano' AS chave, q.ano::VARCHAR AS v FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id UNION ALL SELECT l.prova_cadastrada_id, 'cargo', q.cargo FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id
UNION ALL SELECT p.id, 'ano', f.ano::VARCHAR FROM provas_cadastradas p JOIN documentos_fonte f ON f.id = p.documento_fonte_questoes_id UNION ALL SELECT p.id, 'cargo', f.cargo FROM provas_cadastradas p JOIN documentos_fonte f ON f.id = p.documento_fonte_questoes_id)
SELECT id, chave, array_to_string(list_sort(list_distinct(list(v))), '|') AS valores FROM v WHERE v IS NOT NULL AND id IN (SELECT prova_cadastrada_id FROM prova_cadastrada_questoes) GROUP BY 1, 2""")
def metadata_union(spark, d):
    """Years and roles that the questions of an exam and its source document name, united by kind."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), F.col("ano").cast("string").alias("ano"), "cargo")
    a = _links(spark, d).join(q, "questao_id").groupBy(F.col("prova_id").alias("id")).agg(F.create_map(F.lit("ano"), F.collect_set("ano"), F.lit("cargo"), F.collect_set("cargo")).alias("a"))
    f = table(spark, d, "documentos_fonte").select(F.col("id").alias("f"), F.col("ano").cast("string").alias("ano"), "cargo")
    b = table(spark, d, "provas_cadastradas").select("id", F.col("documento_fonte_questoes_id").alias("f")).join(f, "f")
    b = b.select("id", F.create_map(F.lit("ano"), F.array_compact(F.array("ano")), F.lit("cargo"), F.array_compact(F.array("cargo"))).alias("b"))
    empty = F.array().cast("array<string>")
    both = F.map_zip_with("a", F.coalesce("b", F.create_map().cast("map<string,array<string>>")), lambda k, x, y: F.array_sort(F.array_union(F.coalesce(x, empty), F.coalesce(y, empty))))
    e = a.join(b, "id", "left").select("id", F.explode(both).alias("chave", "v")).where(F.size("v") > 0)
    return e.select("id", "chave", F.array_join("v", "|").alias("valores"))


@query("""SELECT l.prova_cadastrada_id AS id, sha256(string_agg(t, chr(10) ORDER BY t)) AS assinatura FROM (SELECT questao_id, prova_cadastrada_id FROM prova_cadastrada_questoes) l
JOIN (SELECT id, '{"gabarito":' || coalesce('"' || gabarito || '"', 'null') || ',"numero":' || coalesce(numero_oficial::VARCHAR, 'null') || ',"tipo":' || coalesce('"' || tipo || '"', 'null') || '}' AS t FROM questoes) q ON q.id = l.questao_id GROUP BY 1""")
def regression_signature(spark, d):
    """A digest of what an import found, without ids, dates and order."""
    row = F.to_json(F.struct("gabarito", F.col("numero_oficial").alias("numero"), "tipo"), {"ignoreNullFields": "false"})
    j = _links(spark, d).join(table(spark, d, "questoes").select(F.col("id").alias("questao_id"), row.alias("t")), "questao_id")
    return j.groupBy(F.col("prova_id").alias("id")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("t")), "\n"), 256).alias("assinatura"))


@query("""WITH l AS (SELECT questao_id, prova_cadastrada_id AS p FROM prova_cadastrada_questoes UNION ALL SELECT questao_id, prova_cadastrada_id + 1 FROM prova_cadastrada_questoes WHERE questao_id % 50 = 0), g AS (SELECT questao_id, count(DISTINCT p) AS n, min(p) AS p FROM l WHERE questao_id % 30 <> 1 GROUP BY 1)
SELECT q.id, CASE WHEN n = 1 THEN 'prova-' || p WHEN n IS NULL THEN 'fonte-' || q.id % 7 END AS grupo, coalesce(n > 1, false) AS em_varias FROM questoes q LEFT JOIN g ON g.questao_id = q.id""")
def example_group(spark, d):
    """The group of an example: its only exam, else its source; questions of several exams have none."""
    l = _links(spark, d).select("questao_id", F.col("prova_id").alias("p"))  # noqa: E741
    l = l.unionByName(l.where("questao_id % 50 = 0").withColumn("p", F.col("p") + 1)).where("questao_id % 30 <> 1")  # noqa: E741
    g = l.groupBy(F.col("questao_id").alias("id")).agg(F.countDistinct("p").alias("n"), F.min("p").alias("p"))
    j = table(spark, d, "questoes").select("id").join(g, "id", "left")
    name = F.when(F.col("n") == 1, F.concat(F.lit("prova-"), F.col("p").cast("string"))).when(F.col("n").isNull(), F.concat(F.lit("fonte-"), (F.col("id") % 7).cast("string")))
    return j.select("id", name.alias("grupo"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("em_varias"))
