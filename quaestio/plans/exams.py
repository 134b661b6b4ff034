"""Queries over mock exams, attempts and study statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.operators import exams as E
from quaestio.operators import relational as R
from quaestio.operators.ranges import gap_sessions, row_numbers
from quaestio.plans.registry import Registry
from quaestio.plans.sql import key_sql
from quaestio.session import table

query = Registry()
_R = "(SELECT DISTINCT * FROM respostas)"


@query(f"""SELECT q.disciplina, count(*) AS total, count(*) FILTER (r.correta) AS acertos,
round(count(*) FILTER (r.correta) / count(*) * 100, 6) AS percentual FROM {_R} r JOIN questoes q ON q.id = r.questao_id WHERE q.disciplina <> '' GROUP BY 1""")
def accuracy_by_subject(spark, d):
    """Answers and right answers of each subject; replays count once, inactive questions count."""
    return E.accuracy_by(E.responses_once(table(spark, d, "respostas")), table(spark, d, "questoes"), "disciplina")


@query(f"""SELECT (SELECT count(*) FROM questoes WHERE ativa) AS questoes_ativas, (SELECT count(*) FROM provas) AS simulados,
(SELECT count(*) FROM tentativas WHERE finalizada_em IS NOT NULL) AS finalizadas, count(*) AS respostas, count(*) FILTER (correta) AS acertos,
round(count(*) FILTER (correta) / count(*) * 100, 6) AS percentual FROM {_R}""")
def dashboard_summary(spark, d):
    """One row of totals."""
    r = E.responses_once(table(spark, d, "respostas")).agg(F.count("*").alias("respostas"), F.count_if("correta").alias("acertos"))
    q = table(spark, d, "questoes").agg(F.count_if("ativa").alias("questoes_ativas"))
    p = table(spark, d, "provas").agg(F.count("*").alias("simulados"))
    t = table(spark, d, "tentativas").agg(F.count_if(F.col("finalizada_em").isNotNull()).alias("finalizadas"))
    one = [x.withColumn("_", F.lit(1)) for x in (q, p, t, r)]
    row = one[0].join(one[1], "_").join(one[2], "_").join(one[3], "_").drop("_")
    return row.withColumn("percentual", F.round(F.when(F.col("respostas") > 0, F.col("acertos") / F.col("respostas") * 100).otherwise(0.0), 6))


@query(f"""SELECT q.id, q.disciplina, count(*) AS erros FROM {_R} r JOIN questoes q ON q.id = r.questao_id WHERE r.correta = false
GROUP BY 1, 2 ORDER BY erros DESC, q.id LIMIT 20""")
def most_missed(spark, d):
    """The twenty questions most often answered wrong; ties by id."""
    return E.most_missed(E.responses_once(table(spark, d, "respostas")), table(spark, d, "questoes"), 20)


@query("""SELECT id, prova_id, strftime(iniciada_em, '%Y-%m-%d %H:%M:%S') AS inicio, nota, row_number() OVER (PARTITION BY prova_id ORDER BY iniciada_em, id)::INTEGER AS ordem
FROM tentativas WHERE finalizada_em IS NOT NULL""")
def score_trend(spark, d):
    """Finished attempts of each exam in the order they started."""
    t = table(spark, d, "tentativas").where("finalizada_em IS NOT NULL")
    t = row_numbers(t, ["prova_id"], F.to_date("iniciada_em"), ["iniciada_em", "id"], "ordem")
    return t.select("id", "prova_id", F.date_format("iniciada_em", "yyyy-MM-dd HH:mm:ss").alias("inicio"), "nota", "ordem")


@query("""SELECT p.id, p.nome, count(t.id) AS n_tentativas, coalesce(bool_or(t.finalizada_em IS NOT NULL), false) AS concluida,
coalesce(bool_or(t.finalizada_em IS NULL AND t.id IS NOT NULL), false) AS aberta,
CASE WHEN TRY_CAST(json_extract_string(p.filtros, '$.ano') AS INTEGER) >= 0 THEN TRY_CAST(json_extract_string(p.filtros, '$.ano') AS INTEGER) END AS ano_pedido
FROM provas p LEFT JOIN tentativas t ON t.prova_id = p.id GROUP BY 1, 2, p.filtros""")
def exam_listing(spark, d):
    """Mock exams with their attempts, flags of finished and open ones, and a number read from their filters."""
    per = table(spark, d, "tentativas").groupBy(F.col("prova_id").alias("id")).agg(
        F.count("*").alias("n"), F.max(F.col("finalizada_em").isNotNull()).alias("c"), F.max(F.col("finalizada_em").isNull()).alias("a")
    )
    year = F.get_json_object("filtros", "$.ano").try_cast("int")
    f = F.lit(False)
    return table(spark, d, "provas").join(per, "id", "left").select(
        "id", "nome", F.coalesce("n", F.lit(0)).alias("n_tentativas"), F.coalesce("c", f).alias("concluida"), F.coalesce("a", f).alias("aberta"),
        F.when(year >= 0, year).alias("ano_pedido"),
    )


@query("""SELECT prova_id, id AS tentativa_id, nota FROM (SELECT *, row_number() OVER (PARTITION BY prova_id ORDER BY iniciada_em DESC, id DESC) AS k
FROM tentativas WHERE prova_id IS NOT NULL) WHERE k = 1""")
def latest_attempt_of_exam(spark, d):
    """The latest attempt of each exam; equal times by id."""
    t = table(spark, d, "tentativas").where("prova_id IS NOT NULL")
    last = t.groupBy("prova_id").agg(F.max_by(F.struct("id", "nota"), F.struct("iniciada_em", "id")).alias("m"))
    return last.select("prova_id", F.col("m.id").alias("tentativa_id"), "m.nota")


@query(f"""SELECT r.tentativa_id, count(*) FILTER (coalesce(c <> 'Anulada', true)) AS total,
count(*) FILTER (coalesce(c <> 'Anulada', true) AND m = c) AS acertos,
round(CASE WHEN count(*) FILTER (coalesce(c <> 'Anulada', true)) > 0 THEN count(*) FILTER (coalesce(c <> 'Anulada', true) AND m = c) / count(*) FILTER (coalesce(c <> 'Anulada', true)) * 100 ELSE 0 END, 6) AS nota
FROM (SELECT r.tentativa_id, {key_sql('q.gabarito', 'q.tipo')} AS c, {key_sql('r.resposta_marcada', 'q.tipo')} AS m FROM {_R} r JOIN questoes q ON q.id = r.questao_id) r GROUP BY 1""")
def attempt_scoring(spark, d):
    """Each attempt marked again from the keys."""
    return E.scored(E.responses_once(table(spark, d, "respostas")), table(spark, d, "questoes"))


_EVENTS = f"""SELECT r.questao_id, r.correta, r.id, t.iniciada_em, row_number() OVER (PARTITION BY r.questao_id ORDER BY t.iniciada_em, r.id) AS k
FROM {_R} r JOIN tentativas t ON t.id = r.tentativa_id WHERE r.correta IS NOT NULL AND t.iniciada_em IS NOT NULL"""
_SR = f"""WITH RECURSIVE e AS ({_EVENTS}), s AS (
SELECT questao_id, k, iniciada_em AS quando, 1 AS i, 25 AS f, CASE WHEN correta THEN 1 ELSE 0 END AS n FROM e WHERE k = 1
UNION ALL SELECT e.questao_id, e.k, e.iniciada_em,
 CASE WHEN NOT e.correta THEN 1 WHEN s.n = 0 THEN 1 WHEN s.n = 1 THEN 6 ELSE least(36500, round_even(s.i * s.f / 10.0, 0))::INTEGER END,
 CASE WHEN e.correta THEN least(25, s.f + 1) ELSE greatest(13, s.f - 2) END, CASE WHEN e.correta THEN s.n + 1 ELSE 0 END
 FROM s JOIN e ON e.questao_id = s.questao_id AND e.k = s.k + 1),
l AS (SELECT s.* FROM s JOIN (SELECT questao_id, max(k) AS k FROM s GROUP BY 1) USING (questao_id, k)),
estado AS (SELECT questao_id, CAST(quando::DATE + CASE WHEN n > 0 THEN i ELSE 0 END AS VARCHAR) AS proxima_revisao, i AS intervalo_dias, round(f / 10.0, 6)::DOUBLE AS fator_facilidade, n AS acertos_seguidos FROM l)"""


def _events(spark, d):
    t = table(spark, d, "tentativas").select(F.col("id").alias("tentativa_id"), "iniciada_em")
    return E.responses_once(table(spark, d, "respostas")).join(t, "tentativa_id")


@query(f"{_SR} SELECT * FROM estado")
def spaced_repetition_state(spark, d):
    """The spaced-repetition state of each question after all its answers in time order."""
    return E.spaced_repetition(_events(spark, d), "questao_id", "iniciada_em", "id", "correta")


@query(f"{_SR} SELECT questao_id, proxima_revisao FROM estado JOIN questoes q ON q.id = questao_id WHERE q.ativa AND q.gabarito <> 'Anulada' AND proxima_revisao <= '2022-06-30'")
def due_reviews(spark, d):
    """Questions due by a day: active and with a key that isn't void (a missing key drops out)."""
    state = spaced_repetition_state(spark, d).where("proxima_revisao <= '2022-06-30'")
    q = table(spark, d, "questoes").where("ativa AND gabarito <> 'Anulada'").select(F.col("id").alias("questao_id"))
    return state.join(q, "questao_id", "left_semi").select("questao_id", "proxima_revisao")


@query("""WITH g AS (SELECT id, criada_em, lag(criada_em) OVER (ORDER BY id) AS a FROM questoes),
n AS (SELECT *, sum(CASE WHEN criada_em IS NULL OR a IS NULL OR epoch_us(criada_em) - epoch_us(a) > 600000000 OR criada_em < a THEN 1 ELSE 0 END) OVER (ORDER BY id) AS s FROM g)
SELECT s::BIGINT AS sessao, count(*) AS n, min(id) AS primeira, max(id) AS ultima FROM n GROUP BY 1 HAVING count(*) > 1""")
def import_sessions_gap(spark, d):
    """Runs of questions created within ten minutes of the one before, in id order; single ones are dropped."""
    s = gap_sessions(table(spark, d, "questoes").select("id", "criada_em"), "id", "criada_em", 600)
    return s.groupBy("sessao").agg(F.count("*").alias("n"), F.min("id").alias("primeira"), F.max("id").alias("ultima")).where("n > 1")


@query("""WITH s AS (SELECT l.prova_cadastrada_id AS id, array_agg(DISTINCT q.orgao) FILTER (q.orgao <> '') AS o, array_agg(DISTINCT q.ano) FILTER (q.ano IS NOT NULL) AS a,
min(q.criada_em) AS c FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id GROUP BY 1)
SELECT id, CASE WHEN len(o) = 1 AND len(a) = 1 THEN o[1] || ' · ' || a[1] WHEN len(o) = 1 THEN o[1] ELSE strftime(c, '%d/%m/%Y') END AS rotulo FROM s""")
def session_labels(spark, d):
    """A name of each imported group: its only agency and year, else its agency, else its first day."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "orgao", "ano", "criada_em")
    g = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").groupBy(F.col("prova_cadastrada_id").alias("id"))
    g = g.agg(F.collect_set(F.when(F.col("orgao") != "", F.col("orgao"))).alias("o"), F.collect_set("ano").alias("a"), F.min("criada_em").alias("c"))
    one = F.size("o") == 1
    name = F.when(one & (F.size("a") == 1), F.concat_ws(" · ", F.col("o")[0], F.col("a")[0].cast("string"))).when(one, F.col("o")[0])
    return g.select("id", name.otherwise(F.date_format("c", "dd/MM/yyyy")).alias("rotulo"))


_SEED = "semente-7"


@query(f"""SELECT row_number() OVER (ORDER BY md5('{_SEED}' || id), id)::INTEGER AS ordem, id AS questao_id FROM (SELECT id FROM questoes
WHERE ativa AND tipo = 'multipla_escolha' AND gabarito IN ('A','B','C','D','E') ORDER BY md5('{_SEED}' || id), id LIMIT 30)""")
def seeded_sample_exam(spark, d):
    """An exam of thirty random questions, the same for one seed."""
    q = R.evaluable(table(spark, d, "questoes")).where("tipo = 'multipla_escolha'").select("id")
    picked = E.sample(q, "id", 30, _SEED)
    order = [F.md5(F.concat(F.lit(_SEED), F.col("id").cast("string"))), F.col("id")]
    return E.numbered(picked.withColumn("_", F.lit(0)), ["_"], order, "ordem").select("ordem", F.col("id").alias("questao_id"))


@query("""SELECT l.prova_cadastrada_id AS id, array_to_string(list(q.id ORDER BY l.ordem, q.id) FILTER (q.ativa AND q.gabarito IS NOT NULL), ',') AS incluidas,
array_to_string(list_sort(list(q.id) FILTER (NOT (q.ativa AND q.gabarito IS NOT NULL))), ',') AS excluidas
FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id GROUP BY 1""")
def partial_exam(spark, d):
    """Each imported exam copied without its unusable questions, in its own order, with the ids left out."""
    ok = (F.col("ativa") & F.col("gabarito").isNotNull()).alias("ok")
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), ok)
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").groupBy(F.col("prova_cadastrada_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("ordem", "questao_id")))).alias("i"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("questao_id")))).alias("e")
    )
    text = F.when(F.size("i") > 0, F.array_join(F.transform("i", lambda x: x["questao_id"].cast("string")), ","))
    return j.select("id", text.alias("incluidas"), F.when(F.size("e") > 0, F.array_join(F.transform("e", lambda x: x.cast("string")), ",")).alias("excluidas"))


@query("""SELECT p.id, row_number() OVER (PARTITION BY p.id ORDER BY x.k)::INTEGER AS ordem, x.q AS questao_id FROM provas_cadastradas p,
LATERAL (SELECT q, min(k) AS k FROM (SELECT unnest([p.id % 7 + 1, p.id % 5 + 1, p.id % 7 + 1, 3]) AS q, unnest([1, 2, 3, 4]) AS k) GROUP BY q) x""")
def exam_from_list(spark, d):
    """Exams from lists of ids: repeated ids keep their first place."""
    p = table(spark, d, "provas_cadastradas")
    ids = F.array(F.col("id") % 7 + 1, F.col("id") % 5 + 1, F.col("id") % 7 + 1, F.lit(3).cast("long"))
    return p.select("id", F.posexplode(F.array_distinct(ids)).alias("k", "questao_id")).select("id", (F.col("k") + 1).alias("ordem"), "questao_id")


@query(f"""SELECT tentativa_id, questao_id, resposta_marcada FROM (SELECT *, row_number() OVER (PARTITION BY tentativa_id, questao_id ORDER BY id DESC) AS k FROM {_R}) WHERE k = 1""")
def progress_latest_wins(spark, d):
    """The last stored response of each item of an attempt."""
    g = table(spark, d, "respostas").groupBy("tentativa_id", "questao_id").agg(F.max_by("resposta_marcada", "id").alias("resposta_marcada"))
    return g


@query(f"""SELECT tentativa_id, count(*) AS itens, count(*) FILTER (resposta_marcada IS NOT NULL) AS respondidos, count(*) FILTER (resposta_marcada IS NULL) AS em_branco
FROM (SELECT DISTINCT tentativa_id, questao_id, resposta_marcada FROM {_R}) GROUP BY 1""")
def attempt_progress(spark, d):
    """Answered and unanswered items of each attempt."""
    r = table(spark, d, "respostas").select("tentativa_id", "questao_id", "resposta_marcada").distinct()
    n = F.col("resposta_marcada").isNotNull()
    return r.groupBy("tentativa_id").agg(F.count("*").alias("itens"), F.count_if(n).alias("respondidos"), F.count_if(~n).alias("em_branco"))


@query(f"""SELECT p.id AS prova_cadastrada_id, count(DISTINCT r.tentativa_id) AS n_tentativas FROM provas_cadastradas p JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = p.id
JOIN respostas r ON r.questao_id = l.questao_id JOIN tentativas t ON t.id = r.tentativa_id GROUP BY 1""")
def related_attempts(spark, d):
    """Attempts that touch each imported exam: distinct pairs first, so hot questions shrink before the join."""
    r = table(spark, d, "respostas").select("questao_id", "tentativa_id").distinct()
    r = r.join(table(spark, d, "tentativas").select(F.col("id").alias("tentativa_id")), "tentativa_id", "left_semi")
    j = r.join(table(spark, d, "prova_cadastrada_questoes").select("questao_id", "prova_cadastrada_id"), "questao_id")
    return j.groupBy("prova_cadastrada_id").agg(F.countDistinct("tentativa_id").alias("n_tentativas"))


@query("""SELECT a.arquivo_questoes AS arquivo, l.ordem, q.gabarito FROM provas_cadastradas a JOIN prova_cadastrada_questoes l ON l.prova_cadastrada_id = a.id
JOIN questoes q ON q.id = l.questao_id WHERE q.gabarito IS NOT NULL""")
def gold_answers(spark, d):
    """The stored answers of each file in order."""
    q = table(spark, d, "questoes").where("gabarito IS NOT NULL").select(F.col("id").alias("questao_id"), "gabarito")
    p = table(spark, d, "provas_cadastradas").select(F.col("id").alias("prova_cadastrada_id"), F.col("arquivo_questoes").alias("arquivo"))
    return table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").join(p, "prova_cadastrada_id").select("arquivo", "ordem", "gabarito")


@query("""SELECT CASE WHEN prova_id IS NULL THEN 'avulsa' ELSE 'simulado' END AS grupo, count(*) AS n, round(avg(tempo_gasto_seg), 3) AS media_seg
FROM tentativas WHERE finalizada_em IS NOT NULL GROUP BY 1""")
def session_time_means(spark, d):
    """Mean duration of finished attempts by kind; attempts that are still open are left out."""
    t = table(spark, d, "tentativas").where("finalizada_em IS NOT NULL")
    kind = F.when(F.col("prova_id").isNull(), "avulsa").otherwise("simulado")
    return t.groupBy(kind.alias("grupo")).agg(F.count("*").alias("n"), F.round(F.avg("tempo_gasto_seg"), 3).alias("media_seg"))
