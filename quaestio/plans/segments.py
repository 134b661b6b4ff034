"""Queries that cut documents into questions and carry support texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestio.functions.text import comparison_text
from quaestio.operators import segments as S
from quaestio.plans.registry import Registry
from quaestio.session import table

query = Registry()

_OLD = "documents WHERE source = 'provas_antigas'"
_BLOCKS = rf"""b AS (SELECT doc_id, unnest(p[2:]) AS b, generate_subscripts(p[2:], 1) - 1 AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^[ \t]*(\d{{1,3}})[.)][ \t]+', chr(30) || '\1' || chr(31), 'g'), chr(30)) AS p FROM {_OLD})),
c AS (SELECT doc_id, k, string_split(b, chr(31))[1]::INTEGER AS numero, regexp_replace(substr(b, length(string_split(b, chr(31))[1]) + 2), '^\s+|\s+$', '', 'g') AS corpo FROM b)"""
_PARTS = rf"""x AS (SELECT doc_id, k, numero, corpo, string_split(regexp_replace(corpo, '(?m)^[ \t]*\(?([A-E])\)[ \t]+', chr(30) || '\1', 'g'), chr(30)) AS p FROM c),
y AS (SELECT *, list_transform(p[2:], lambda z: {{'letra': substr(z, 1, 1), 'texto': regexp_replace(substr(z, 2), '^\s+|\s+$', '', 'g')}}) AS o FROM x),
w AS (SELECT *, coalesce(list_max(list_filter(list_transform(o, lambda z, i: CASE WHEN z.letra = 'A' THEN i - 1 END), lambda i: i IS NOT NULL)), 0) AS u FROM y),
v AS (SELECT doc_id, k, numero, regexp_replace(regexp_replace(p[1], '^\s+|\s+$', '', 'g') || array_to_string(list_transform(o[1:u], lambda z: chr(10) || '(' || z.letra || ') ' || z.texto), ''), '^\s+|\s+$', '', 'g') AS enunciado, o[u + 1:] AS opcoes FROM w)"""


def _old_exams(spark, d):
    return table(spark, d, "documents").where("source = 'provas_antigas'").select("doc_id", "text")


@query(f"WITH {_BLOCKS} SELECT doc_id, k::INTEGER AS k, numero, corpo FROM c")
def segment_blocks(spark, d):
    """The numbered blocks of old exams."""
    return S.blocks(_old_exams(spark, d), ["doc_id"], "text", "pontuada")


@query(f"""WITH {_BLOCKS}, {_PARTS} SELECT doc_id, numero, enunciado, len(opcoes)::INTEGER AS n_opcoes, array_to_string(list_transform(opcoes, lambda z: z.letra || ')' || z.texto), '|') AS opcoes,
CASE WHEN len(opcoes) > 0 THEN 'multipla_escolha' ELSE 'certo_errado' END AS tipo,
CASE WHEN len(opcoes) >= 4 THEN 'alta' WHEN len(opcoes) >= 1 THEN 'media' WHEN length(enunciado) >= 80 THEN 'alta' WHEN length(enunciado) >= 30 THEN 'media' ELSE 'baixa' END AS confianca FROM v WHERE length(enunciado) >= 10""")
def parse_questions(spark, d):
    """The questions of old exams: number, stem, options, kind and confidence."""
    p = S.parsed(S.blocks(_old_exams(spark, d), ["doc_id"], "text", "pontuada"))
    text = F.array_join(F.transform("opcoes", lambda o: F.concat(o["letra"], F.lit(")"), o["texto"])), "|")
    return p.select("doc_id", "numero", "enunciado", F.size("opcoes").alias("n_opcoes"), text.alias("opcoes"), "tipo", "confianca")


@query(f"SELECT confianca AS nivel, count(*) AS n, count(*) FILTER (n_opcoes > 0) AS com_opcoes FROM ({query.sql['parse_questions']}) GROUP BY 1")
def confidence_histogram(spark, d):
    """Questions read from old exams by how sure the reading is."""
    p = parse_questions(spark, d)
    return p.groupBy(F.col("confianca").alias("nivel")).agg(F.count("*").alias("n"), F.count_if(F.col("n_opcoes") > 0).alias("com_opcoes"))


def _booklets(spark, d):
    """A booklet printed from each imported exam: clean questions under named markers, with their options."""
    clean = F.regexp_replace(F.regexp_replace("enunciado", r"\s+", " "), r"(?i)quest.o", "pergunta")
    letters = F.when(F.col("letra").isin(*S.LETTERS), F.struct("letra", F.col("id"), F.trim(F.regexp_replace("texto", r"\s+", " ")).alias("t")))
    o = table(spark, d, "alternativas").groupBy("questao_id").agg(F.array_sort(F.collect_list(letters)).alias("o"))
    q = table(spark, d, "questoes").where("length(trim(enunciado)) >= 10").select(F.col("id").alias("questao_id"), F.trim(clean).alias("e"))
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").join(o, "questao_id", "left")
    lines = F.array_join(F.transform(F.coalesce("o", F.array()), lambda x: F.concat(F.lit("\n"), x["letra"], F.lit(") "), x["t"])), "")
    one = F.concat(F.lit("QUESTÃO "), F.col("ordem").cast("string"), F.lit("\n"), F.col("e"), lines)
    g = j.groupBy(F.col("prova_cadastrada_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordem", "questao_id", one.alias("t")))).alias("b"))
    return g.select("id", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("texto"))


@query(r"""WITH o AS (SELECT questao_id, count(*) FILTER (letra IN ('A','B','C','D','E') AND texto IS NOT NULL) AS n FROM alternativas GROUP BY 1)
SELECT l.prova_cadastrada_id AS id, l.ordem AS numero, trim(regexp_replace(regexp_replace(enunciado, '\s+', ' ', 'g'), '(?i)quest.o', 'pergunta', 'g')) AS enunciado, coalesce(o.n, 0)::INTEGER AS n_opcoes
FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id LEFT JOIN o ON o.questao_id = q.id WHERE length(trim(enunciado)) >= 10 AND length(trim(regexp_replace(enunciado, '\s+', ' ', 'g'))) >= 10""")
def parse_questions_roundtrip(spark, d):
    """Booklets printed from the bank and parsed back: numbers, stems and options come out as they went in."""
    p = S.parsed(S.blocks(_booklets(spark, d), ["id"], "texto", "questoes_nomeadas"))
    return p.select("id", "numero", "enunciado", F.size("opcoes").alias("n_opcoes"))


@query()
def segment_competition(spark, d):
    """The profile that cuts each old exam best, with its score."""
    c = S.compete(_old_exams(spark, d), "doc_id", "text")
    return c.select("doc_id", "perfil", "pontos.distintos", "pontos.validos", "pontos.defeitos", "empate")


@query("""SELECT l.prova_cadastrada_id AS escopo, l.ordem, last_value(q.texto_apoio IGNORE NULLS) OVER (PARTITION BY l.prova_cadastrada_id ORDER BY l.ordem, l.questao_id) AS apoio
FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id""")
def labelled_asof_support(spark, d):
    """The last support text at or before each question of an exam."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "texto_apoio")
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id")
    w = Window.partitionBy("prova_cadastrada_id").orderBy("ordem", "questao_id")
    return j.select(F.col("prova_cadastrada_id").alias("escopo"), "ordem", F.last("texto_apoio", ignorenulls=True).over(w).alias("apoio"))


@query("""WITH j AS (SELECT l.prova_cadastrada_id AS escopo, l.ordem, l.questao_id, q.texto_apoio IS NOT NULL AS declara, 2 + q.id % 3 AS quantas, q.texto_apoio FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id),
p AS (SELECT *, sum(declara::INT) OVER (PARTITION BY escopo ORDER BY ordem, questao_id) AS d FROM j),
i AS (SELECT *, row_number() OVER (PARTITION BY escopo, d ORDER BY ordem, questao_id) AS i, count(*) OVER (PARTITION BY escopo, d) AS n,
 max(CASE WHEN declara THEN quantas END) OVER (PARTITION BY escopo, d) AS k, max(CASE WHEN declara THEN texto_apoio END) OVER (PARTITION BY escopo, d) AS t FROM p)
SELECT escopo, questao_id, CASE WHEN d > 0 AND i <= k AND n >= k THEN t END AS apoio FROM i""")
def relative_next_k_support(spark, d):
    """Support texts declared for the next questions: exactly as many must follow before the next declaration."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), F.col("texto_apoio").isNotNull().alias("declara"), (2 + F.col("id") % 3).alias("quantas"), "texto_apoio")
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").withColumnRenamed("prova_cadastrada_id", "escopo")
    return S.next_k_support(j, "escopo", ["ordem", "questao_id"], "declara", "quantas", "texto_apoio").select("escopo", "questao_id", "apoio")


_CMP = r"trim(regexp_replace(replace(lower(regexp_replace({}, '(\p{{L}})-\s*\n\s*(\p{{L}})', '\1\2', 'g')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH r AS (SELECT id, unnest(string_split(texto_apoio, chr(10))) AS t, generate_subscripts(string_split(texto_apoio, chr(10)), 1) AS n FROM questoes WHERE texto_apoio IS NOT NULL),
s AS (SELECT id, n, {_CMP.format('t')} AS t FROM r), a AS (SELECT id, trim(substr({_CMP.format('texto_apoio')}, 40, 60)) AS agulha FROM questoes WHERE texto_apoio IS NOT NULL),
h AS (SELECT x.id, x.n AS i, y.n AS j FROM s x JOIN s y ON y.id = x.id AND y.n >= x.n JOIN a ON a.id = x.id
 WHERE contains((SELECT string_agg(z.t, ' ' ORDER BY z.n) FROM s z WHERE z.id = x.id AND z.n BETWEEN x.n AND y.n), a.agulha) AND length(a.agulha) > 0)
SELECT id, i::INTEGER AS de, j::INTEGER AS ate FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY j - i, i, j) AS k FROM h) WHERE k = 1""")
def containment_windows(spark, d):
    """The shortest run of lines of a support text that contains a passage of it."""
    q = table(spark, d, "questoes").where("texto_apoio IS NOT NULL")
    r = q.select("id", F.posexplode(F.split("texto_apoio", "\n")).alias("n", "t")).select("id", "n", comparison_text(F.col("t")).alias("texto"))
    a = q.select("id", F.trim(F.substring(comparison_text(F.col("texto_apoio")), 40, 60)).alias("agulha")).where("agulha <> ''")
    return S.smallest_window(r, a, "id")
