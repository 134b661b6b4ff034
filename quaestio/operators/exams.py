"""Attempts, scoring, samples, spaced repetition and study statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.functions.keys import normalize_key

#: Fixed values of spaced repetition, the ease in tenths: start, least, after a right and a wrong answer; longest interval.
EASE, LEAST_EASE, RIGHT, WRONG, LONGEST = 25, 13, 1, -2, 36_500
RUN = 40  # steps of an unbroken run of right answers after which the interval has long been the longest


def responses_once(responses: DataFrame) -> DataFrame:
    """Responses without replays: of rows with one id, any, as their content is the same."""
    return responses.dropDuplicates(["id"])


def accuracy_by(responses: DataFrame, questions: DataFrame, field: str) -> DataFrame:
    """(field, total, acertos, percentual): unknown correctness counts as answered; blank groups are left out.

    Responses are counted by question first, so the join moves one row a question, however hot it is.
    """
    per = responses.groupBy(F.col("questao_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("correta").alias("c"))
    joined = per.join(questions.where(F.col(field) != "").select("id", field), "id")
    agg = joined.groupBy(field).agg(F.sum("n").alias("total"), F.sum("c").alias("acertos"))
    return agg.withColumn("percentual", F.round(F.when(F.col("total") > 0, F.col("acertos") / F.col("total") * 100).otherwise(0.0), 6))


def most_missed(responses: DataFrame, questions: DataFrame, n: int) -> DataFrame:
    per = responses.where("correta = false").groupBy(F.col("questao_id").alias("id")).agg(F.count("*").alias("erros"))
    return per.join(questions.select("id", "disciplina"), "id").orderBy(F.desc("erros"), "id").limit(n)


def scored(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """(tentativa_id, total, acertos, nota): void items leave the denominator, blanks and foreign keys count as wrong.

    Items are the questions an attempt has a row for, as where no composition is known; see ``scored_by_composition``.
    A response is right if its key, read by the question's kind, is the question's own. Responses are
    joined with one row a question, which is small beside them, and counted by attempt.
    """
    keys = questions.select(F.col("id").alias("questao_id"), "tipo", normalize_key(F.col("gabarito"), F.col("tipo")).alias("chave"))
    j = responses.join(keys, "questao_id")
    counts = F.coalesce(F.col("chave") != "Anulada", F.lit(True))
    right = counts & (normalize_key(F.col("resposta_marcada"), F.col("tipo")) == F.col("chave"))
    agg = j.groupBy("tentativa_id").agg(F.count_if(counts).alias("total"), F.count_if(right).alias("acertos"))
    return agg.withColumn("nota", _grade())


def _grade() -> Column:
    return F.round(F.when(F.col("total") > 0, F.col("acertos") / F.col("total") * 100).otherwise(0.0), 6)


def composition(items: DataFrame, questions: DataFrame, snapshots: DataFrame, fields: list[str]) -> DataFrame:
    """Items of exams (prova_id, questao_id, ordem) with the content they were pinned with.

    snapshots: questao_id, conteudo (JSON). A field that a snapshot holds, null included, replaces the question's
    own; an item without a snapshot has the present content and ``sem_snapshot``.
    """
    q = questions.select(F.col("id").alias("questao_id"), *fields)
    s = snapshots.select("questao_id", F.from_json("conteudo", "map<string,string>").alias("_s"))
    j = items.join(q, "questao_id").join(s, "questao_id", "left")
    pinned = lambda f: F.when(F.coalesce(F.map_contains_key("_s", f), F.lit(False)), F.col("_s")[f]).otherwise(F.col(f).cast("string"))
    return j.select("prova_id", "ordem", "questao_id", *[pinned(f).alias(f) for f in fields], F.col("_s").isNull().alias("sem_snapshot"))


def scored_by_composition(attempts: DataFrame, responses: DataFrame, composed: DataFrame) -> DataFrame:
    """(tentativa_id, total, acertos, nota, alheias): every item that isn't void counts, answered or not.

    attempts: id, prova_id; composed: prova_id, questao_id, tipo, gabarito. Items are counted by exam, so
    only answers are joined with items. An answer to no item of the exam is counted in ``alheias`` and scores nothing; of several answers to an item the
    last stored one counts.
    """
    key = normalize_key(F.col("gabarito"), F.col("tipo"))
    items = composed.select("prova_id", "questao_id", "tipo", key.alias("chave"), F.coalesce(key != "Anulada", F.lit(True)).alias("vale"))
    total = items.groupBy("prova_id").agg(F.count_if("vale").alias("total"))
    last = responses.groupBy("tentativa_id", "questao_id").agg(F.max_by("resposta_marcada", "id").alias("m"))
    a = attempts.where("prova_id IS NOT NULL").select(F.col("id").alias("tentativa_id"), "prova_id").join(total, "prova_id")
    met = last.join(a.select("tentativa_id", "prova_id"), "tentativa_id").join(items, ["prova_id", "questao_id"], "left")
    right = F.col("vale") & (normalize_key(F.col("m"), F.col("tipo")) == F.col("chave"))
    per = met.groupBy("tentativa_id").agg(F.count_if(right).alias("acertos"), F.count_if(F.col("vale").isNull()).alias("alheias"))
    out = a.join(per, "tentativa_id", "left").select("tentativa_id", "total", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("acertos", "alheias")])
    return out.withColumn("nota", _grade())


def attempt_start(exams: DataFrame, attempts: DataFrame, items: DataFrame) -> DataFrame:
    """(prova_id, decisao, tentativa_id, indisponiveis): what starting an attempt at each exam does.

    items: prova_id, liberada. A finished exam is refused, an open attempt reused, an exam without items or
    with items that aren't released refused; else an attempt is new.
    """
    t = attempts.groupBy("prova_id").agg(F.max(F.col("finalizada_em").isNotNull()).alias("f"), F.min(F.when(F.col("finalizada_em").isNull(), F.col("id"))).alias("aberta"))
    i = items.groupBy("prova_id").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("liberada", F.lit(False))).alias("fora"))
    j = exams.select(F.col("id").alias("prova_id")).join(t, "prova_id", "left").join(i, "prova_id", "left")
    done, n, out = F.coalesce("f", F.lit(False)), F.coalesce("n", F.lit(0)), F.coalesce("fora", F.lit(0))
    what = F.when(done, "finalizada").when(F.col("aberta").isNotNull(), "reaberta").when(n == 0, "vazia").when(out > 0, "indisponivel").otherwise("nova")
    return j.select("prova_id", what.alias("decisao"), F.when(what == "reaberta", F.col("aberta")).alias("tentativa_id"), F.when(what == "indisponivel", out).alias("indisponiveis"))


def _step(f: Column, right: Column) -> Column:
    """A map of the ease, e -> min(max(e + soma, baixo), alto), followed by one answer; such maps are closed under this."""
    move = F.when(right, RIGHT).otherwise(WRONG)
    low, high = F.when(right, 0).otherwise(LEAST_EASE), F.when(right, EASE).otherwise(99)
    bound = lambda x: F.least(F.greatest(x + move, low), high)
    return F.struct((f["soma"] + move).alias("soma"), bound(f["baixo"]).alias("baixo"), bound(f["alto"]).alias("alto"))


def _apply(f: Column, ease: Column) -> Column:
    return F.least(F.greatest(ease + f["soma"], f["baixo"]), f["alto"])


def spaced_repetition(events: DataFrame, key: str, time: str, order: str, right: str) -> DataFrame:
    """(key, proxima_revisao, intervalo_dias, fator_facilidade, acertos_seguidos) after all events of each key, in time order.

    Right: the interval is 1, then 6, then the one before times the old ease, rounded half to even, up
    to LONGEST days; the ease grows by 0.1 to 2.5. Wrong: interval 1, due the same day, the ease falls
    by 0.2 to 1.3, except that a key's very first answer leaves it at 2.5. Events without a time or
    without a known answer are left out.

    Events of one key may be a third of all. The effect of a stretch of answers on the ease is a small
    map, and maps compose; so answers are folded by key and day first, and then the days of a key.
    What comes after the last wrong answer is a count.
    """
    ev = events.where(F.col(right).isNotNull() & F.col(time).isNotNull())
    ev = ev.select(key, F.col(time).alias("t"), F.col(order).alias("o"), F.col(right).alias("r"), F.to_date(time).alias("_d"))
    day = ev.groupBy(key, "_d").agg(F.array_sort(F.collect_list(F.struct("t", "o", "r"))).alias("e"))
    kind = "struct<soma:int,baixo:int,alto:int>"
    ident = F.struct(F.lit(0).alias("soma"), F.lit(0).alias("baixo"), F.lit(99).alias("alto")).cast(kind)
    fold = lambda xs: F.aggregate(xs, ident, lambda f, x: _step(f, x["r"]).cast(kind))
    last_wrong = F.size("e") - F.coalesce(F.array_position(F.reverse(F.transform("e", lambda x: x["r"])), False), F.lit(0))
    n = F.size("e")
    has_wrong = F.exists("e", lambda x: ~x["r"])
    until = F.when(has_wrong, last_wrong + 1).otherwise(0)  # answers up to the last wrong one
    first_wrong = ~F.col("e")[0]["r"]
    tail = F.slice("e", F.lit(2), F.greatest(n - 1, F.lit(0)))
    days = day.select(
        key, "_d", has_wrong.alias("errou"), (n - until).cast("int").alias("depois"), F.col("e")[n - 1]["t"].alias("quando"),
        fold(F.col("e")).alias("f"), fold(F.slice("e", F.lit(1), until)).alias("g"),
        F.when(first_wrong, fold(tail)).otherwise(fold(F.col("e"))).alias("f1"),
        F.when(first_wrong, fold(F.slice("e", F.lit(2), F.greatest(until - 1, F.lit(0))))).otherwise(fold(F.slice("e", F.lit(1), until))).alias("g1"),
    )
    per = days.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "errou", "depois", "quando", "f", "g", "f1", "g1"))).alias("ds"))
    state = "struct<i:int,agora:int,base:int,seguidos:int>"
    zero = F.struct(F.lit(0).alias("i"), F.lit(EASE).alias("agora"), F.lit(EASE).alias("base"), F.lit(0).alias("seguidos")).cast(state)

    def one_day(s: Column, x: Column) -> Column:
        first = s["i"] == 0
        whole, cut = F.when(first, x["f1"]).otherwise(x["f"]), F.when(first, x["g1"]).otherwise(x["g"])
        return F.struct(
            (s["i"] + 1).alias("i"), _apply(whole, s["agora"]).alias("agora"),
            F.when(x["errou"], _apply(cut, s["agora"])).otherwise(s["base"]).alias("base"),
            F.when(x["errou"], x["depois"]).otherwise(s["seguidos"] + x["depois"]).alias("seguidos"),
        ).cast(state)

    out = per.select(key, F.aggregate("ds", zero, one_day).alias("s"), F.element_at("ds", -1)["quando"].alias("quando"))
    run, base = F.col("s.seguidos"), F.col("s.base")

    def grow(i: Column, k: Column) -> Column:
        ease = F.least(F.lit(EASE), base + (k - 1) * RIGHT)
        more = F.least(F.lit(LONGEST), F.bround(i * ease / 10).cast("int"))
        return F.when(k == 1, 1).when(k == 2, 6).otherwise(more).cast("int")

    steps = F.when(run > 0, F.sequence(F.lit(1), F.least(run, F.lit(RUN)))).otherwise(F.array().cast("array<int>"))
    interval = F.when(run > 0, F.aggregate(steps, F.lit(1), grow)).otherwise(1)
    due = F.date_add(F.to_date("quando"), F.when(run > 0, interval).otherwise(0))
    return out.select(
        key, due.cast("string").alias("proxima_revisao"), interval.cast("int").alias("intervalo_dias"),
        F.round(F.col("s.agora") / 10, 6).alias("fator_facilidade"), run.alias("acertos_seguidos"),
    )


def sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same for one seed: those of smallest keyed digest; n <= 0 gives none."""
    return df.withColumn("_k", F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))).orderBy("_k", id_col).limit(max(0, n)).drop("_k")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
