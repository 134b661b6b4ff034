"""Queries over the question bank: search, options, structure, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.functions.keys import normalize_key, official_number
from quaestio.functions.text import preview, suspicious_start
from quaestio.operators import relational as R
from quaestio.plans.registry import Registry
from quaestio.plans.sql import ALNUM_START, key_sql
from quaestio.schemas import CONFIRMED, EVALUABLE
from quaestio.session import table

query = Registry()
_EV = ", ".join(f"'{k}'" for k in EVALUABLE)
_CO = ", ".join(f"'{k}'" for k in CONFIRMED)
_NEST = "array_to_string(list_sort(list(coalesce(letra,'') || ')' || coalesce(texto,''))), '|')"


@query(f"""SELECT q.id, q.disciplina, coalesce(o.opcoes, '') AS opcoes FROM questoes q
LEFT JOIN (SELECT questao_id, {_NEST} AS opcoes FROM alternativas GROUP BY 1) o ON o.questao_id = q.id
WHERE q.ativa AND contains(lower(q.enunciado), 'contrato') AND q.tipo = 'multipla_escolha'""")
def question_search(spark, d):
    """Active questions whose stem contains a text, with optional filters, and their options nested."""
    found = R.search(table(spark, d, "questoes"), "contrato", {"tipo": "multipla_escolha", "banca": None, "disciplina": ""})
    return R.with_options(found, table(spark, d, "alternativas")).select("id", "disciplina", F.array_join(R.option_texts(), "|").alias("opcoes"))


@query("""SELECT 'disciplina' AS campo, disciplina AS valor FROM questoes WHERE disciplina <> '' GROUP BY 2
UNION ALL SELECT 'topico', topico FROM questoes WHERE topico <> '' GROUP BY 2
UNION ALL SELECT 'banca', banca FROM questoes WHERE banca <> '' GROUP BY 2""")
def filter_options_distinct(spark, d):
    """Distinct filled values of each filter field, inactive questions included."""
    return R.distinct_values(table(spark, d, "questoes"), ["disciplina", "topico", "banca"])


@query(f"SELECT id, gabarito FROM questoes WHERE ativa AND gabarito IN ({_EV})")
def evaluable_questions(spark, d):
    """Active questions whose key, as stored, can be marked."""
    return R.evaluable(table(spark, d, "questoes")).select("id", "gabarito")


@query(f"SELECT id, gabarito, {key_sql('gabarito', 'tipo')} AS normal FROM questoes")
def normalized_keys(spark, d):
    """Each key in the vocabulary of the domain."""
    return table(spark, d, "questoes").select("id", "gabarito", normalize_key(F.col("gabarito"), F.col("tipo")).alias("normal"))


@query(f"""SELECT q.id, count(a.id) AS n_opcoes, {_NEST} AS opcoes
FROM questoes q JOIN alternativas a ON a.questao_id = q.id GROUP BY 1""")
def options_nested(spark, d):
    """Questions with their options as one sorted list."""
    nested = R.with_options(table(spark, d, "questoes").select("id"), table(spark, d, "alternativas")).where("size(opcoes) > 0")
    return nested.select("id", F.size("opcoes").cast("long").alias("n_opcoes"), F.array_join(R.option_texts(), "|").alias("opcoes"))


@query(rf"""WITH o AS (SELECT questao_id, list_sort(list(letra) FILTER (trim(coalesce(texto,'')) <> '' AND letra IS NOT NULL)) AS letras,
  bool_or(regexp_matches(coalesce(texto,''), '\s[b-eB-E]\)\s+\S') AND NOT contains(coalesce(texto,''), '(')) AS fundida FROM alternativas GROUP BY 1)
SELECT id, array_to_string(list_filter([
  CASE WHEN trim(coalesce(enunciado,'')) = '' THEN 'enunciado_vazio' END,
  CASE WHEN coalesce(gabarito,'') <> '' AND {key_sql('gabarito', 'tipo')} IS NULL THEN 'gabarito_incompativel' END,
  CASE WHEN regexp_matches(coalesce(enunciado,''), '(?i)(^|[^\p{{L}}\p{{N}}_])(alternativa que|afirmação que)\s*$') THEN 'comando_incompleto' END,
  CASE WHEN tipo = 'multipla_escolha' AND (coalesce(len(letras), 0) < 2 OR letras <> ['A','B','C','D','E'][1:len(letras)]) THEN 'alternativas_invalidas' END,
  CASE WHEN tipo = 'multipla_escolha' AND gabarito IN ('A','B','C','D','E') AND NOT coalesce(list_contains(letras, gabarito), false) THEN 'alternativa_do_gabarito_ausente' END,
  CASE WHEN tipo = 'multipla_escolha' AND coalesce(fundida, false) THEN 'alternativas_fundidas' END,
  CASE WHEN regexp_matches(coalesce(enunciado,''), '(?i)TIPO\s+[\p{{L}}\p{{N}}_]+\s*[–—-]\s*P[ÁA]GINA\s+\d+') THEN 'rodape_misturado' END], lambda x: x IS NOT NULL), ',') AS problemas
FROM questoes LEFT JOIN o ON o.questao_id = id""")
def structure_problems(spark, d):
    """Codes of structural problems of each question, in a fixed order."""
    return R.structure_problems(table(spark, d, "questoes"), table(spark, d, "alternativas"))


@query(f"SELECT id, coalesce(regexp_matches(regexp_replace(enunciado, '{ALNUM_START}', ''), '^\\p{{Ll}}'), false) AS suspeito FROM questoes")
def suspicious_starts(spark, d):
    """Whether a stem starts in lower case after signs."""
    return table(spark, d, "questoes").select("id", suspicious_start(F.col("enunciado")).alias("suspeito"))


@query(r"""WITH n AS (SELECT registro_id, trim(json_extract_string(lower(registro), '$.numero')) AS t,
  json_extract_string(lower(registro), '$.numero') AS r FROM importacoes_brutas)
SELECT registro_id, CASE WHEN regexp_matches(coalesce(t,''), '^[1-9][0-9]{0,8}$') THEN t::INTEGER END AS numero,
  CASE WHEN r IS NULL OR t = '' THEN 'numeracao_ausente' WHEN NOT regexp_matches(t, '^[1-9][0-9]{0,8}$') THEN 'numeracao_invalida' END AS motivo FROM n""")
def official_numbers(spark, d):
    """Official number of each raw record: explicit, canonical and positive, or the reason why there is none."""
    raw = table(spark, d, "importacoes_brutas").select("registro_id", F.get_json_object(F.lower("registro"), "$.numero").alias("r"))
    number, reason = official_number(F.col("r"))
    return raw.select("registro_id", number.alias("numero"), reason.alias("motivo"))


@query(f"""WITH o AS (SELECT questao_id, count(*) AS n, count(DISTINCT upper(trim(letra))) FILTER (upper(trim(letra)) IN ('A','B','C','D','E')) AS u,
  list(upper(trim(letra))) AS l FROM alternativas GROUP BY 1)
SELECT id, CASE WHEN trim(coalesce(enunciado,'')) = '' THEN 'enunciado_vazio'
 WHEN tipo IS NULL OR tipo NOT IN ('multipla_escolha','certo_errado') THEN 'tipo_invalido'
 WHEN tipo = 'multipla_escolha' AND coalesce(n, 0) < 2 THEN 'poucas_opcoes'
 WHEN tipo = 'multipla_escolha' AND u <> n THEN 'letras_repetidas'
 WHEN gabarito IS NOT NULL AND {key_sql('gabarito', 'tipo')} IS NULL THEN 'gabarito_invalido'
 WHEN tipo = 'multipla_escolha' AND length({key_sql('gabarito', 'tipo')}) = 1 AND NOT list_contains(l, {key_sql('gabarito', 'tipo')}) THEN 'opcao_do_gabarito_ausente'
 WHEN ano < 1900 OR ano > 2100 THEN 'ano_invalido' END AS erro FROM questoes LEFT JOIN o ON questao_id = id""")
def editor_validation(spark, d):
    """The first rule that a question breaks, or null."""
    return R.first_error(table(spark, d, "questoes"), table(spark, d, "alternativas"))


@query(f"""SELECT p.id, p.nome, count(q.id) AS n_questoes, count(q.id) FILTER (q.gabarito IN ({_CO})) AS n_com_gabarito,
 count(q.id) - count(q.id) FILTER (q.gabarito IN ({_CO})) AS n_sem_gabarito,
 count(q.id) > 0 AND count(q.id) = count(q.id) FILTER (q.gabarito IN ({_CO})) AS pronta
FROM provas_cadastradas p LEFT JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = p.id LEFT JOIN questoes q ON q.id = l.questao_id GROUP BY 1, 2""")
def imported_exam_readiness(spark, d):
    """Questions of each imported exam with and without a confirmed key; empty exams count 0."""
    return R.exam_readiness(*(table(spark, d, t) for t in ("provas_cadastradas", "prova_cadastrada_questoes", "questoes")))


@query("""SELECT id, CASE WHEN n = 0 THEN 'vazia' WHEN k = n THEN 'pronta' WHEN k = 0 THEN 'sem gabarito' ELSE 'parcial ' || k || ' de ' || n END AS estado
FROM (SELECT p.id, count(q.id) AS n, count(q.id) FILTER (q.gabarito IN (%s)) AS k FROM provas_cadastradas p
LEFT JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = p.id LEFT JOIN questoes q ON q.id = l.questao_id GROUP BY 1)""" % _CO)
def exam_status(spark, d):
    """A label of how far an imported exam can be used."""
    r = imported_exam_readiness(spark, d)
    n, k = F.col("n_questoes"), F.col("n_com_gabarito")
    label = F.when(n == 0, "vazia").when(k == n, "pronta").when(k == 0, "sem gabarito").otherwise(F.format_string("parcial %d de %d", k, n))
    return r.select("id", label.alias("estado"))


@query("""SELECT q.id FROM questoes q WHERE q.ativa AND NOT EXISTS (SELECT 1 FROM prova_cadastrada_questoes l
JOIN provas_cadastradas p ON p.id = l.prova_cadastrada_id AND p.ativa WHERE l.questao_id = q.id)""")
def orphan_questions_anti(spark, d):
    """Active questions in no active imported exam."""
    used = table(spark, d, "prova_cadastrada_questoes").join(
        table(spark, d, "provas_cadastradas").where("ativa").select(F.col("id").alias("prova_cadastrada_id")), "prova_cadastrada_id", "left_semi"
    )
    return table(spark, d, "questoes").where("ativa").join(used.select(F.col("questao_id").alias("id")), "id", "left_anti").select("id")


@query("""SELECT a.id, a.questao_id, a.letra FROM alternativas a WHERE a.questao_id IN (SELECT questao_id FROM respostas WHERE correta = false)""")
def options_of_missed_semi(spark, d):
    """Options of the questions that were answered wrong at least once."""
    missed = table(spark, d, "respostas").where("correta = false").select("questao_id")
    return table(spark, d, "alternativas").join(missed, "questao_id", "left_semi").select("id", "questao_id", "letra")


@query("""SELECT id, CASE WHEN length(enunciado) > 110 THEN substr(enunciado, 1, 110) || '...' ELSE enunciado END AS previa FROM questoes""")
def preview_texts(spark, d):
    """Stems cut for a list."""
    return table(spark, d, "questoes").select("id", preview(F.col("enunciado"), 110).alias("previa"))


@query(f"""WITH k AS (SELECT id, gabarito, {key_sql('gabarito', 'tipo')} AS n FROM questoes)
SELECT id, n IS NULL AS sem_resposta, n IS NOT NULL AND n <> 'Anulada' AS respondida, coalesce(n = 'Anulada', false) AS anulada FROM k""")
def key_list_filters(spark, d):
    """The list filters by key: without answer, answered, void."""
    n = normalize_key(F.col("gabarito"), F.col("tipo"))
    return table(spark, d, "questoes").select(
        "id", n.isNull().alias("sem_resposta"), (n.isNotNull() & (n != "Anulada")).alias("respondida"), F.coalesce(n == "Anulada", F.lit(False)).alias("anulada")
    )


@query("""SELECT 'importada' AS origem, id, nome, ativa FROM provas_cadastradas UNION ALL SELECT 'simulado', id, nome, true FROM provas""")
def exam_sources_union(spark, d):
    """Imported and mock exams in one list with their origin."""
    a = table(spark, d, "provas_cadastradas").select(F.lit("importada").alias("origem"), "id", "nome", "ativa")
    return a.unionByName(table(spark, d, "provas").select(F.lit("simulado").alias("origem"), "id", "nome", F.lit(True).alias("ativa")))


@query("""SELECT p.id, min(q.orgao) AS orgao FROM provas_cadastradas p JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = p.id
JOIN questoes q ON q.id = l.questao_id WHERE q.orgao <> '' GROUP BY p.id HAVING count(DISTINCT q.orgao) = 1""")
def unique_agency_of_exam(spark, d):
    """The agency of an exam where its questions name exactly one."""
    links = table(spark, d, "prova_cadastrada_questoes").join(table(spark, d, "questoes").where("orgao <> ''").select(F.col("id").alias("questao_id"), "orgao"), "questao_id")
    return R.only_value(links, "prova_cadastrada_id", "orgao").withColumnRenamed("prova_cadastrada_id", "id")


@query("SELECT tabela, n FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tabela, count(*) AS n FROM {t}" for t in ("questoes", "alternativas", "documentos_fonte", "provas_cadastradas", "prova_cadastrada_questoes", "provas", "tentativas", "respostas")) + ")")
def table_counts(spark, d):
    """Rows of every table of the bank."""
    return R.table_counts({t: table(spark, d, t) for t in ("questoes", "alternativas", "documentos_fonte", "provas_cadastradas", "prova_cadastrada_questoes", "provas", "tentativas", "respostas")})


@query("""SELECT * FROM (SELECT 'opcao_sem_questao' AS caso, count(*) AS n FROM alternativas a WHERE NOT EXISTS (SELECT 1 FROM questoes q WHERE q.id = a.questao_id)
UNION ALL SELECT 'resposta_sem_tentativa', count(*) FROM respostas r WHERE NOT EXISTS (SELECT 1 FROM tentativas t WHERE t.id = r.tentativa_id)
UNION ALL SELECT 'resposta_repetida', (count(*) - count(DISTINCT id))::BIGINT FROM respostas
UNION ALL SELECT 'prova_sem_fonte_de_gabarito', count(*) FROM provas_cadastradas WHERE documento_fonte_gabarito_id IS NULL
UNION ALL SELECT 'questao_de_multipla_escolha_sem_opcoes', count(*) FROM questoes q WHERE tipo = 'multipla_escolha' AND NOT EXISTS (SELECT 1 FROM alternativas a WHERE a.questao_id = q.id))""")
def database_audit(spark, d):
    """Counts of broken links and missing parts."""
    q, a, r, t, p = (table(spark, d, x) for x in ("questoes", "alternativas", "respostas", "tentativas", "provas_cadastradas"))
    return R.audit(q, a, r, t, p)


@query("SELECT disciplina, count(*) AS n FROM questoes WHERE ano >= 2015 GROUP BY 1")
def raw_sql(spark, d):
    """A parameterized SQL statement over the tables."""
    return R.raw_sql(spark, "SELECT disciplina, count(*) AS n FROM {questoes} WHERE ano >= :desde GROUP BY 1", {"desde": 2015}, questoes=table(spark, d, "questoes"))
