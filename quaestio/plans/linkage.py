"""Queries over answer keys: linkage, merges, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions.keys import TF, bulk_tokens, is_key_token, normalize_key
from quaestio.operators import linkage as L
from quaestio.plans.registry import Registry
from quaestio.plans.sql import key_sql
from quaestio.session import table

query = Registry()


def _questions(spark, d):
    """Questions by exam as scope, with their official number and the letters of their filled options."""
    filled = F.upper(F.trim(F.when(F.trim("texto") != "", F.col("letra"))))
    letters = table(spark, d, "alternativas").groupBy("questao_id").agg(F.collect_set(filled).alias("letras"))
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), F.col("numero_oficial").alias("numero"), "tipo", "gabarito")
    links = table(spark, d, "prova_cadastrada_questoes").select("questao_id", F.col("prova_cadastrada_id").alias("escopo"), "ordem")
    return q.join(links, "questao_id").join(letters, "questao_id", "left")


def _answers(spark, d):
    """A key built from the bank: scoped answers by printed order, one letter in eleven shifted, and some for any scope."""
    q = _questions(spark, d)
    shifted = F.when((F.col("questao_id") % 11 == 0) & F.col("gabarito").isin("A", "B", "C", "D"), F.translate("gabarito", "ABCD", "BCDE")).otherwise(F.col("gabarito"))
    scoped = q.where("gabarito IS NOT NULL AND questao_id % 13 <> 0").select("escopo", F.col("ordem").alias("numero"), shifted.alias("resposta"))
    anywhere = q.where("gabarito IS NOT NULL AND questao_id % 97 = 0").groupBy((F.col("ordem") + 60).alias("numero")).agg(F.min("gabarito").alias("resposta"))
    return scoped.unionByName(anywhere.select(F.lit(None).cast("long").alias("escopo"), "numero", "resposta"))


_Q = """l AS (SELECT questao_id, list_distinct(list(upper(trim(letra))) FILTER (trim(texto) <> '' AND letra IS NOT NULL)) AS letras FROM alternativas GROUP BY 1),
q AS (SELECT q.id AS questao_id, q.numero_oficial AS numero, q.tipo, q.gabarito, p.prova_cadastrada_id AS escopo, p.ordem, CASE WHEN l.questao_id IS NOT NULL THEN coalesce(l.letras, []) END AS letras
 FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id LEFT JOIN l ON l.questao_id = q.id),
a AS (SELECT escopo, ordem AS numero, CASE WHEN questao_id % 11 = 0 AND gabarito IN ('A','B','C','D') THEN translate(gabarito,'ABCD','BCDE') ELSE gabarito END AS resposta
 FROM q WHERE gabarito IS NOT NULL AND questao_id % 13 <> 0
 UNION ALL SELECT NULL, ordem + 60, min(gabarito) FROM q WHERE gabarito IS NOT NULL AND questao_id % 97 = 0 GROUP BY 2),
s AS (SELECT numero, count(DISTINCT escopo) AS escopos FROM q WHERE numero IS NOT NULL GROUP BY 1)"""
_LINK = f"""WITH {_Q}, j AS (SELECT q.*, count(*) OVER (PARTITION BY q.escopo, q.numero) AS iguais, s.escopos, p.resposta AS propria, g.resposta AS geral,
 coalesce(p.resposta, CASE WHEN s.escopos = 1 THEN g.resposta END) AS dada FROM q LEFT JOIN s ON s.numero = q.numero
 LEFT JOIN a p ON p.escopo = q.escopo AND p.numero = q.numero LEFT JOIN a g ON g.escopo IS NULL AND g.numero = q.numero),
n AS (SELECT *, {key_sql('dada', 'tipo')} AS nova, {key_sql('gabarito', 'tipo')} AS velha FROM j),
v AS (SELECT escopo, numero, questao_id, nova, CASE WHEN numero IS NULL THEN 'numeracao' WHEN iguais > 1 THEN 'duplicado'
 WHEN propria IS NULL AND geral IS NOT NULL AND escopos > 1 THEN 'escopo_divergente' WHEN dada IS NULL THEN 'faltante'
 WHEN nova IS NULL OR (coalesce(tipo,'') <> 'certo_errado' AND letras IS NOT NULL AND nova IN ('A','B','C','D','E') AND NOT list_contains(letras, nova)) THEN 'incompativel'
 WHEN velha IS NOT NULL AND velha <> nova THEN 'conflito' ELSE 'vinculada' END AS situacao FROM n),
r AS (SELECT escopo, numero, questao_id, situacao, CASE WHEN situacao = 'vinculada' THEN nova END AS resposta FROM v
 UNION ALL SELECT escopo, numero, NULL, 'extra', NULL FROM a WHERE numero NOT IN (SELECT numero FROM s))"""


@query(f"{_LINK} SELECT * FROM r")
def answer_linkage(spark, d):
    """Every question and every unmet answer with its linkage state; only unique, compatible matches are linked."""
    return L.link_answers(_questions(spark, d).drop("ordem"), _answers(spark, d))


@query(f"{_LINK} SELECT escopo, array_to_string(list_sort(list_distinct(list(situacao) FILTER (situacao <> 'vinculada'))), ',') AS motivos, count(*) FILTER (situacao = 'vinculada') AS vinculadas FROM r GROUP BY 1")
def linkage_summary(spark, d):
    """The reasons of review of each exam, and how many answers were linked."""
    r = answer_linkage(spark, d)
    reasons = F.array_sort(F.collect_set(F.when(F.col("situacao") != "vinculada", F.col("situacao"))))
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, ","))
    return r.groupBy("escopo").agg(text.alias("motivos"), F.count_if(F.col("situacao") == "vinculada").alias("vinculadas"))


@query(f"{_LINK} SELECT escopo, count(*) AS extraidas, count(*) FILTER (situacao = 'vinculada') AS vinculadas, round(count(*) FILTER (situacao = 'vinculada') / count(*), 6) AS cobertura, count(*) - count(*) FILTER (situacao = 'vinculada') AS ganho_possivel FROM r WHERE situacao <> 'extra' GROUP BY 1")
def coverage_report(spark, d):
    """Answer coverage of each exam and what it could still gain."""
    return L.coverage(answer_linkage(spark, d), "escopo").orderBy(F.desc("ganho_possivel"), "escopo")


_OBS = """o AS (SELECT p.prova_cadastrada_id AS escopo, q.numero_oficial AS numero, trim(q.gabarito) AS resposta, 1 + (q.id % 3)::INTEGER AS prioridade
FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id WHERE q.numero_oficial IS NOT NULL AND trim(q.gabarito) <> ''
UNION ALL SELECT p.prova_cadastrada_id, q.numero_oficial, CASE WHEN q.id % 5 = 0 THEN 'X' ELSE trim(q.gabarito) END, 1 + ((q.id + 1) % 3)::INTEGER
FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id WHERE q.numero_oficial IS NOT NULL AND trim(q.gabarito) <> ''),
e AS (SELECT *, CASE upper(resposta) WHEN 'X' THEN 'Anulada' WHEN 'ANULADA' THEN 'Anulada' WHEN 'CERTO' THEN 'Certo' WHEN 'ERRADO' THEN 'Errado' ELSE resposta END AS r FROM o)"""


def _observations(spark, d):
    """Answers of two readings at three priorities; the second reads some as void."""
    links = table(spark, d, "prova_cadastrada_questoes").select(F.col("questao_id").alias("id"), F.col("prova_cadastrada_id").alias("escopo"))
    q = table(spark, d, "questoes").where("numero_oficial IS NOT NULL AND trim(gabarito) <> ''").join(links, "id")
    key, number = F.trim("gabarito"), F.col("numero_oficial").alias("numero")
    one = q.select("escopo", number, key.alias("resposta"), (1 + F.col("id") % 3).cast("int").alias("prioridade"))
    two = q.select("escopo", number, F.when(F.col("id") % 5 == 0, "X").otherwise(key).alias("resposta"), (1 + (F.col("id") + 1) % 3).cast("int").alias("prioridade"))
    return one.unionByName(two)


@query(f"WITH {_OBS} SELECT escopo, numero, CASE WHEN min(r) = max(r) THEN min(r) END AS resposta, min(r) <> max(r) AS conflito FROM e GROUP BY 1, 2")
def answer_merge_conflicts(spark, d):
    """All readings merged: a number with two different answers keeps none."""
    return L.merge_observations(_observations(spark, d), ["escopo", "numero"])


@query(f"""WITH {_OBS}, n AS (SELECT escopo, numero, prioridade, CASE WHEN min(r) = max(r) THEN min(r) END AS resposta, min(r) <> max(r) AS conflito FROM e GROUP BY 1, 2, 3)
SELECT escopo, numero, resposta, conflito, prioridade FROM (SELECT *, row_number() OVER (PARTITION BY escopo, numero ORDER BY prioridade) AS k FROM n) WHERE k = 1""")
def answer_priority_fill(spark, d):
    """Each number from its best source; a conflict there is kept, not refilled."""
    return L.fill_by_priority(_observations(spark, d), ["escopo", "numero"], "prioridade")


_N = "n AS (SELECT p.prova_cadastrada_id AS escopo, q.numero_oficial AS numero FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id)"


@query(f"WITH {_N}, t AS (SELECT escopo, max(numero) AS m FROM n WHERE numero > 0 GROUP BY 1) SELECT escopo, coalesce((SELECT string_agg(k::VARCHAR, ',' ORDER BY k) FROM range(1, m + 1) r(k) WHERE k NOT IN (SELECT numero FROM n WHERE n.escopo = t.escopo AND numero IS NOT NULL)), '') AS faltam FROM t")
def number_gaps(spark, d):
    """Official numbers missing in each exam."""
    return L.sequence_gaps(_questions(spark, d), "escopo", "numero")


@query(f"WITH {_N} SELECT escopo, numero, count(*) AS n FROM n WHERE numero IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def number_duplicates(spark, d):
    """Official numbers that several questions of an exam have."""
    return L.duplicates(_questions(spark, d).where("numero IS NOT NULL"), ["escopo", "numero"])


@query("""WITH c AS (SELECT p.prova_cadastrada_id AS escopo, q.banca, count(*) AS n FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id WHERE q.banca <> '' GROUP BY 1, 2)
SELECT escopo, banca, n FROM (SELECT *, row_number() OVER (PARTITION BY escopo ORDER BY n DESC, banca DESC) AS k FROM c) WHERE k = 1""")
def board_mode(spark, d):
    """The most frequent board of each exam."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "banca")
    j = q.join(table(spark, d, "prova_cadastrada_questoes").select("questao_id", F.col("prova_cadastrada_id").alias("escopo")), "questao_id")
    return L.mode(j, "escopo", "banca")


@query(f"""SELECT p.prova_cadastrada_id AS escopo, count(*) AS extraidas, max(q.numero_oficial)::BIGINT AS declaradas, count(*) FILTER ({key_sql('q.gabarito', 'q.tipo')} IS NOT NULL) AS com_gabarito,
array_to_string(list_sort(list_distinct(list(q.tipo))), ',') AS tipos, count(*) FILTER (q.imagem_path IS NOT NULL) AS com_imagem
FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id GROUP BY 1""")
def import_report(spark, d):
    """What the import of each exam found."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "numero_oficial", "tipo", "gabarito", "imagem_path")
    j = q.join(table(spark, d, "prova_cadastrada_questoes").select("questao_id", F.col("prova_cadastrada_id").alias("escopo")), "questao_id")
    return j.groupBy("escopo").agg(
        F.count("*").alias("extraidas"), F.max("numero_oficial").cast("long").alias("declaradas"),
        F.count_if(normalize_key(F.col("gabarito"), F.col("tipo")).isNotNull()).alias("com_gabarito"),
        F.array_join(F.array_sort(F.collect_set("tipo")), ",").alias("tipos"), F.count("imagem_path").alias("com_imagem"),
    )


@query("""SELECT id, array_to_string(list_filter(regexp_split_to_array(upper(texto), '[^\\p{L}]+'), lambda t: t IN ('A','B','C','D','E','CERTO','ERRADO')), ' ') AS marcas
FROM alternativas""")
def bulk_answer_tokens(spark, d):
    """Whole answer tokens in free text; letters inside words are none."""
    return table(spark, d, "alternativas").select("id", F.array_join(bulk_tokens(F.col("texto")), " ").alias("marcas"))


@query("SELECT id, coalesce(upper(trim(gabarito)) IN ('A','B','C','D','E','CERTO','ERRADO','ANULADA','X'), false) AS valida FROM questoes")
def key_tokens_valid(spark, d):
    """Whether a key as stored is a token of any source."""
    return table(spark, d, "questoes").select("id", is_key_token(F.col("gabarito")).alias("valida"))


@query("""WITH t AS (SELECT p.prova_cadastrada_id AS escopo, list(q.tipo ORDER BY p.ordem, q.id) AS tipos, list(upper(trim(coalesce(q.gabarito,'?'))) ORDER BY p.ordem, q.id) AS marcas, count(*) AS n
FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id GROUP BY 1)
SELECT escopo, i::INTEGER AS posicao, CASE WHEN marcas[i] = 'CERTO' OR (marcas[i] = 'C' AND tipos[i] = 'certo_errado') THEN 'Certo' WHEN marcas[i] = 'ERRADO' OR (marcas[i] = 'E' AND tipos[i] = 'certo_errado') THEN 'Errado' ELSE marcas[i] END AS resposta
FROM t, LATERAL (SELECT unnest(range(1, n + 1)) AS i)""")
def bulk_answers_in_order(spark, d):
    """A pasted sequence of answers laid over an exam's questions in order; it applies only where the counts agree."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "tipo", F.upper(F.trim(F.coalesce("gabarito", F.lit("?")))).alias("m"))
    j = q.join(table(spark, d, "prova_cadastrada_questoes"), "questao_id").groupBy(F.col("prova_cadastrada_id").alias("escopo"))
    g = j.agg(F.array_sort(F.collect_list(F.struct("ordem", "questao_id", "tipo", "m"))).alias("s"))
    pasted = g.select("escopo", "s", F.split(F.array_join(F.transform("s", lambda x: x["m"]), " "), " ").alias("marcas"))
    e = pasted.where(F.size("s") == F.size("marcas")).select("escopo", F.posexplode(F.arrays_zip("s", "marcas")).alias("k", "p"))
    m, tf = F.col("p.marcas"), F.col("p.s.tipo") == TF
    answer = F.when((m == "CERTO") | ((m == "C") & tf), "Certo").when((m == "ERRADO") | ((m == "E") & tf), "Errado").otherwise(m)
    return e.select("escopo", (F.col("k") + 1).alias("posicao"), answer.alias("resposta"))


@query("""WITH n AS (SELECT p.prova_cadastrada_id AS escopo, list_sort(list(q.numero_oficial)) AS s, count(*) AS n FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id GROUP BY 1)
SELECT escopo, len(s) = n AND list_distinct(s) IS NOT NULL AND s = list_transform(range(1, n + 1), lambda x: x::INTEGER) AS aceita FROM n""")
def sequence_gate(spark, d):
    """Whether an exam's official numbers are exactly 1 to its count."""
    g = _questions(spark, d).groupBy("escopo").agg(F.array_sort(F.collect_list("numero")).alias("s"), F.count("*").cast("int").alias("n"))
    return g.select("escopo", (F.col("s") == F.sequence(F.lit(1), F.col("n"))).alias("aceita"))


@query("""WITH b AS (SELECT p.prova_cadastrada_id AS escopo, q.numero_oficial AS n, q.id FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id),
f AS (SELECT id AS escopo, 1 + (id % 10)::INTEGER AS de, 10 + (id % 20)::INTEGER AS ate FROM provas_cadastradas)
SELECT b.id, f.de, f.ate FROM b JOIN f ON f.escopo = b.escopo AND b.n BETWEEN f.de AND f.ate""")
def range_support_join(spark, d):
    """Questions in the range of numbers that a shared text names: an equi-join on the exam, then the interval."""
    f = table(spark, d, "provas_cadastradas").select(F.col("id").alias("escopo"), (1 + F.col("id") % 10).cast("int").alias("de"), (10 + F.col("id") % 20).cast("int").alias("ate"))
    j = _questions(spark, d).join(f, "escopo").where(F.col("numero").between(F.col("de"), F.col("ate")))
    return j.select(F.col("questao_id").alias("id"), "de", "ate")
