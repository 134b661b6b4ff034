"""Operators on hand-written rows: edge cases and brute force."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaestio import schemas
from quaestio.functions import catalogs, keys, text
from quaestio.operators import curation, documents, exams, graph, history, keytext, layout, linkage, ranges, relational, segments


def col(df, name):
    return [r[name] for r in df.collect()]


def test_normalize_key(spark):
    cases = [(" c ", None, "C"), ("X", None, "Anulada"), ("anulado", "certo_errado", "Anulada"), ("CERTO", None, None), ("A", "certo_errado", None), ("", None, None), (None, None, None), ("e", "certo_errado", "Errado"), ("E", "multipla_escolha", "E")]
    df = spark.createDataFrame([(i, v, k) for i, (v, k, _) in enumerate(cases)], "i int, v string, k string")
    got = df.orderBy("i").select(keys.normalize_key(F.col("v"), F.col("k")).alias("r"))
    assert col(got, "r") == [c[2] for c in cases]


def test_official_number(spark):
    cases = [("7", 7, None), ("07", None, "numeracao_invalida"), (" 7", 7, None), ("7.5", None, "numeracao_invalida"), ("true", None, "numeracao_invalida"), ("0", None, "numeracao_invalida"), ("-1", None, "numeracao_invalida"), ("", None, "numeracao_ausente"), (None, None, "numeracao_ausente"), ("99999999999", None, "numeracao_invalida")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, v string")
    n, reason = keys.official_number(F.col("v"))
    assert [(r.n, r.m) for r in df.orderBy("i").select(n.alias("n"), reason.alias("m")).collect()] == [(c[1], c[2]) for c in cases]


def test_bulk_tokens(spark):
    df = spark.createDataFrame([(0, "A D B C E certo errado"), (1, "Caderno A Exemplo B"), (2, None)], "i int, v string")
    assert col(df.orderBy("i").select(keys.bulk_tokens(F.col("v")).alias("t")), "t") == [["A", "D", "B", "C", "E", "CERTO", "ERRADO"], ["A", "B"], None]


def test_text_forms(spark):
    df = spark.createDataFrame([("Straße  e a-\nção, IPê_1",)], "v string")
    r = df.select(text.comparison_text(F.col("v")).alias("c"), text.accent_key(F.col("v")).alias("a"), text.preview(F.col("v"), 5).alias("p")).first()
    assert r.c == "strasse e ação ipê_1" and r.a == "straße e a- cao, ipe_1" and r.p == "Straß..."
    v = spark.createDataFrame([("Prova Tipo IV",), ("t2",), ("X",), ("azul",)], "v string").select(text.version_label(F.col("v")).alias("r"))
    assert col(v, "r") == ["4", "2", "10", "AZUL"]


def test_page_normal(spark):
    rows = [(1, " ﬁm\r\nde\t\tＡ\u00a0b\r "), (2, "a  b\n"), (3, None), (4, ""), (5, "ação")]
    df = spark.createDataFrame(rows, "i int, v string")
    assert {r.i: r.p for r in df.select("i", text.page_normal(F.col("v")).alias("p")).collect()} == {1: "fim\nde A b", 2: "a b", 3: None, 4: "", 5: "ação"}


def test_option_lines(spark):
    cases = {"(A) um (B) dois": "\n(A) um \n(B) dois", "a) um b) dois": "\na) um \nb) dois", "(A) um (A) dois": None, "(B) um (A) dois": None, "(A) um b) dois": None, "(A) só": None, "mãe) x (A) um": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.select("v", text.options_on_lines(F.col("v")).alias("p")).collect():
        assert " ".join(r.p.split()) == " ".join((cases[r.v] or r.v).split()) and ("\n" in r.p) == (cases[r.v] is not None), r


def test_subject_and_board(spark):
    df = spark.createDataFrame([("LÍNGUA PORTUGUESA | 20 questões", "prova da fgv"), ("Direito", "nada"), (None, None)], "a string, b string")
    got = df.select(catalogs.subject(F.col("a")).alias("s"), catalogs.board(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Língua Portuguesa", "FGV"), (None, ""), (None, "")]


def _merge(spark, rows):
    df = spark.createDataFrame(rows, "numero int, resposta string")
    return {r.numero: (r.resposta, r.conflito) for r in linkage.merge_observations(df, ["numero"]).collect()}


def test_merge_conflicts(spark):
    assert _merge(spark, [(1, "A"), (1, "B"), (1, "A"), (2, "C")]) == {1: (None, True), 2: ("C", False)}
    assert _merge(spark, [(1, "X"), (1, "Anulada"), (2, "CERTO"), (2, "Certo")]) == {1: ("Anulada", False), 2: ("Certo", False)}
    assert _merge(spark, []) == {}


def test_priority_fill(spark):
    rows = [(1, "A", 1), (1, "B", 2), (2, "A", 2), (2, "B", 2), (3, "C", 1), (3, "D", 1), (3, "C", 2), (4, "E", 3)]
    got = linkage.fill_by_priority(spark.createDataFrame(rows, "numero int, resposta string, p int"), ["numero"], "p").collect()
    assert {r.numero: (r.resposta, r.conflito) for r in got} == {1: ("A", False), 2: (None, True), 3: (None, True), 4: ("E", False)}


def test_link_answers(spark):
    q = [("x", 1, 1, "multipla_escolha", None, ["A", "B"]), ("x", 2, 2, "multipla_escolha", None, ["A"]), ("x", 2, 3, None, None, None), ("x", 3, 4, "multipla_escolha", None, ["A", "B"]), ("x", 5, 5, "multipla_escolha", "A", ["A", "B"]), ("x", None, 6, None, None, None), ("y", 1, 7, "certo_errado", None, None), ("x", 9, 8, "multipla_escolha", None, ["A", "B"]), ("x", 7, 9, "certo_errado", None, None)]
    a = [("x", 1, "A"), ("x", 2, "A"), ("x", 4, "B"), ("x", 5, "B"), (None, 1, "C"), (None, 9, "B"), ("x", 7, "A")]
    qs = spark.createDataFrame(q, "escopo string, numero int, questao_id long, tipo string, gabarito string, letras array<string>")
    got = linkage.link_answers(qs, spark.createDataFrame(a, "escopo string, numero int, resposta string")).collect()
    assert {r.questao_id: (r.situacao, r.resposta) for r in got if r.questao_id} == {1: ("vinculada", "A"), 2: ("duplicado", None), 3: ("duplicado", None), 4: ("faltante", None), 5: ("conflito", None), 6: ("numeracao", None), 7: ("escopo_divergente", None), 8: ("vinculada", "B"), 9: ("incompativel", None)}
    assert [(r.escopo, r.numero) for r in got if r.situacao == "extra"] == [("x", 4)]


def _lines(spark, rows):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "doc int, n int, linha string")


def _read(df):
    return {r.numero: r.resposta for r in linkage.merge_observations(df, ["numero"]).collect() if r.resposta}


@pytest.mark.parametrize(
    "rows,want",
    [
        (["Item 1 2", "Gabarito V F", "Item 3 4", "Gabarito F V"], {1: "Certo", 2: "Errado", 3: "Errado", 4: "Certo"}),
        (["1 2", "3 4", "A B"], {3: "A", 4: "B"}),
        (["1 2", "A", "B C"], {}),
        (["Item 1 2 3", "Gabarito C ? E"], {1: "C", 3: "E"}),
        (["Item 1 2 3", "Gabarito V F X"], {1: "Certo", 2: "Errado", 3: "Anulada"}),
        (["Item 1 2 3", "Gabarito C X E"], {1: "C", 2: "Anulada", 3: "E"}),
        (["opções A e B do item 1 errado"], {}),
        (["3", "Gabarito:", "D"], {3: "D"}),
    ],
)
def test_two_rows(spark, rows, want):
    assert _read(keytext.two_rows(_lines(spark, rows))) == want


def test_key_readers(spark):
    assert _read(keytext.same_line_pairs(_lines(spark, ["Gabarito: 1 - A 02.B 3 C", "1 a 28", "de 5 A 6 B", "9: *  8 D"]))) == {1: "A", 2: "B", 3: "C", 8: "D"}
    assert _read(keytext.spelled_out(_lines(spark, ["QUESTÃO 6: ANULADA", "7 certo 8 falso", "o 9 certo"]))) == {6: "Anulada", 7: "Certo", 8: "Errado"}
    assert _read(keytext.item_grid(_lines(spark, ["Item 1 2 0", "C E 0", "Item 4 5", "C", "Item 6 7", "Gabarito:", "E C", "Item 8", ""]))) == {1: "Certo", 2: "Errado", 6: "Errado", 7: "Certo"}
    two = _lines(spark, ["PROVA 2 PROVA 1", "1 A 2 B 1 C 2 D", "3 A 3 B 4 C"])
    assert _read(keytext.version_columns(two, "1")) == {1: "C", 2: "D"}
    assert _read(keytext.version_columns(two, "3")) == {}


def test_segments(spark):
    body = "QUESTÃO 1\nPrimeira pergunta do caderno\nA) um\nB) dois\nA) três\nB) quatro\nC) cinco\nQUESTAO 02 - Segunda pergunta longa\n(A) x\n(B) y\nQUESTÃO 3\ncurto"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "sem marcas")], "id int, t string")
    got = segments.parsed(segments.blocks(df, ["id"], "t", "questoes_nomeadas")).orderBy("numero").collect()
    assert [(r.numero, r.enunciado, [o.letra for o in r.opcoes], r.tipo, r.confianca) for r in got] == [
        (1, "Primeira pergunta do caderno\n(A) um\n(B) dois", ["A", "B", "C"], "multipla_escolha", "media"),
        (2, "Segunda pergunta longa", ["A", "B"], "multipla_escolha", "media"),
    ]
    assert col(segments.compete(df, "id", "t"), "perfil") == ["questoes_nomeadas"]


def test_next_k(spark):
    rows = [(1, k, k in (1, 4), 2 if k == 1 else 3, f"t{k}") for k in range(6)]
    df = spark.createDataFrame(rows, "g int, o int, d boolean, c int, t string")
    assert {r.o: r.apoio for r in segments.next_k_support(df, "g", ["o"], "d", "c", "t").collect()} == {0: None, 1: "t1", 2: "t1", 3: None, 4: None, 5: None}


def test_smallest_window(spark):
    r = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e f"), (1, 3, "c d e")], "k int, n int, texto string")
    n = spark.createDataFrame([(1, "d e")], "k int, agulha string")
    assert [tuple(x) for x in segments.smallest_window(r, n, "k").collect()] == [(1, 4, 4)]


def test_scoring(spark):
    q = spark.createDataFrame([(1, "multipla_escolha", "A"), (2, "multipla_escolha", "X"), (3, "certo_errado", "Certo"), (4, None, None)], "id long, tipo string, gabarito string")
    r = spark.createDataFrame([(1, 1, " a "), (1, 2, "B"), (1, 3, None), (1, 4, "C"), (2, 2, "A")], "tentativa_id long, questao_id long, resposta_marcada string")
    got = {x.tentativa_id: (x.total, x.acertos, x.nota) for x in exams.scored(r, q).collect()}
    assert got == {1: (3, 1, 33.333333), 2: (0, 0, 0.0)}


def test_scoring_by_composition(spark):
    """Items without an answer lower the grade, void ones don't count, answers to other questions are told and score nothing."""
    composed = spark.createDataFrame([(7, 1, "multipla_escolha", "A"), (7, 2, "multipla_escolha", "X"), (7, 3, "certo_errado", "Certo"), (7, 4, None, None), (8, 1, "multipla_escolha", "X")], "prova_id long, questao_id long, tipo string, gabarito string")
    attempts = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None), (5, 9)], "id long, prova_id long")
    r = spark.createDataFrame([(1, 1, 1, "B"), (2, 1, 1, " a "), (3, 1, 2, "A"), (4, 1, 99, "A"), (5, 3, 1, "A"), (6, 4, 1, "A")], "id long, tentativa_id long, questao_id long, resposta_marcada string")
    got = {x.tentativa_id: (x.total, x.acertos, x.alheias, x.nota) for x in exams.scored_by_composition(attempts, r, composed).collect()}
    assert got == {1: (3, 1, 1, 33.333333), 2: (3, 0, 0, 0.0), 3: (0, 0, 0, 0.0)}


def test_composition_overlay(spark):
    q = spark.createDataFrame([(1, "novo", "A"), (2, "x", None)], "id long, enunciado string, gabarito string")
    items = spark.createDataFrame([(7, 1, 2), (7, 2, 1)], "prova_id long, questao_id long, ordem int")
    old = spark.createDataFrame([(1, '{"enunciado":"velho","gabarito":null}')], "questao_id long, conteudo string")
    got = {r.questao_id: (r.enunciado, r.gabarito, r.sem_snapshot) for r in exams.composition(items, q, old, ["enunciado", "gabarito"]).collect()}
    assert got == {1: ("velho", None, False), 2: ("x", None, True)}


def _fold(answers):
    state = None
    for right in answers:
        known, i, e, n = state or (False, 0, 25, 0)
        if right:
            n += 1
            state = (True, 1 if n == 1 else 6 if n == 2 else min(36500, round(i * e / 10)), min(25, e + 1), n)
        else:
            state = (True, 1, max(13, e - 2) if known else 25, 0)
    return state


def test_spaced_repetition_against_fold(spark):
    rng = random.Random(3)
    rows, want, k = [], {}, 0
    for key in range(120):
        answers = [rng.random() < rng.choice([0.3, 0.7, 0.95]) for _ in range(rng.randint(1, 60))]
        t = datetime(2024, 1, 1)
        for right in answers:
            k += 1
            t += timedelta(hours=rng.choice([0, 1, 30]))
            rows.append((key, k, t, right))
        want[key] = (*_fold(answers)[1:], t.date())
    rows += [(0, 9999, None, True), (1, 9999, datetime(2030, 1, 1), None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "q int, o int, t timestamp_ntz, r boolean")
    got = exams.spaced_repetition(df, "q", "t", "o", "r").collect()
    for r in got:
        i, e, n, day = want[r.q]
        due = day + timedelta(days=i if n else 0)
        assert (r.intervalo_dias, round(r.fator_facilidade * 10), r.acertos_seguidos, r.proxima_revisao) == (i, e, n, str(due))
    assert len(got) == 120


def test_sample(spark):
    df = spark.range(50)
    a, b = col(exams.sample(df, "id", 7, "s"), "id"), col(exams.sample(df, "id", 7, "s"), "id")
    assert sorted(a) == sorted(b) and len(set(a)) == 7
    assert exams.sample(df, "id", 0, "s").count() == 0 and exams.sample(df, "id", 99, "s").count() == 50


def test_order_in_ranges(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randint(0, 9), datetime(2024, 1, 1) + timedelta(seconds=60 * k + rng.choice([0, 0, 200]))) for k in range(300)]
    rows[100] = (100, "a", 1, None)
    df = spark.createDataFrame(rows, "id long, g string, b int, t timestamp_ntz")
    got = {r.id: r.n for r in ranges.row_numbers(df, ["g"], F.col("b"), ["id"], "n").collect()}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            assert got[r[0]] == n
    for width in (7, 100_000):
        s = {r.id: r.sessao for r in ranges.gap_sessions(df, "id", "t", 100, width).collect()}
        now, want = 0, {}
        for k, r in enumerate(rows):
            before = rows[k - 1][3] if k else None
            gap = (r[3] - before).total_seconds() if r[3] and before else None
            now += gap is None or gap > 100 or gap < 0
            want[r[0]] = now
        assert s == want
    assert ranges.gap_sessions(df.where("false"), "id", "t", 100).count() == 0


def test_components_and_split(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (10, 13), (20, 20), (None, 1)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 13: 10}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    chain = [(k, k + 1) for k in range(200)]
    assert set(col(graph.connected_components(spark.createDataFrame(chain, "a int, b int"), "a", "b"), "component")) == {0}
    ex = spark.createDataFrame([(i, f"g{i // 2}", f"f{i // 3}" if i % 2 else None) for i in range(30)], "id long, grupo string, fonte string")
    parts = curation.split(ex, "id", ["grupo", "fonte"]).collect()
    assert len(parts) == 30 and {r.particao for r in parts} <= {"treino", "validacao"}
    one = curation.split(ex.where("id < 2"), "id", ["grupo"]).collect()
    assert [r.particao for r in one] == ["treino", "treino"]


def test_curation_queries_take_every_question(spark, tmp_path):
    """Exams 1 and 2 share a source and exam 3 stands alone; question 9 is in two exams, 41 in none."""
    from quaestio.plans import catalog

    exam = {**{k: 1 for k in range(1, 21)}, **{k: 2 for k in range(21, 31)}, **{k: 3 for k in range(31, 41)}}
    spark.createDataFrame([(k, "certo_errado") for k in range(1, 42)], "id long, tipo string").write.parquet(f"{tmp_path}/questoes.parquet")
    spark.createDataFrame([(p, q) for q, p in exam.items()] + [(2, 9)], "prova_cadastrada_id long, questao_id long").write.parquet(f"{tmp_path}/prova_cadastrada_questoes.parquet")
    spark.createDataFrame([(1, 70), (2, 70), (3, 71)], "id long, documento_fonte_questoes_id long").write.parquet(f"{tmp_path}/provas_cadastradas.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    parts = [(r.id, r.componente, r.particao) for r in run("components_split")]
    assert sorted(parts) == [(k, 1 if k <= 30 else 31 if k <= 40 else 41, "validacao" if k <= 30 else "treino") for k in range(1, 42)]
    assert {r.chave: r.n for r in run("split_leaks")} == {"grupo": 0, "fonte": 0}
    ready = {r.particao: (r.n_componentes, r.n_grupos, r.n_fontes) for r in run("split_readiness")}
    assert ready == {"validacao": (1, 2, 1), "treino": (2, 1, 1)}
    assert {r.imagem: r.grupos for r in run("lineage_merge")} == {f"img-{k}": {9: "1,2", 41: None}.get(k, str(exam.get(k))) for k in range(1, 42)}
    assert {r.particao: r.linhas for r in run("export_manifest")} == {"validacao": 30, "treino": 11}
    assert {r.particao: r.n for r in run("split_readiness")} == {"validacao": 30, "treino": 11}


def test_lineage_conflict(spark):
    df = spark.createDataFrame([("i1", "a", 1, None), ("i1", "a", 2, "s"), ("i2", "a", 1, "s"), ("i2", "b", 1, "s")], "imagem string, rotulo string, grupo int, fonte string")
    got = {r.imagem: (r.situacao, r.grupos) for r in curation.merge_lineage(df, "imagem", "rotulo").collect()}
    assert got == {"i1": ("ok", [1, 2]), "i2": ("conflito", [1])}


def test_history(spark):
    now = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "q int, hash_conteudo string")
    log = spark.createDataFrame([(1, 1, "h0"), (1, 2, "h1"), (2, 4, "old")], "q int, numero_versao int, hash_conteudo string")
    new = history.versions_to_append(now, log, "q")
    assert sorted(map(tuple, new.collect())) == [(2, 5, "h2"), (3, 1, "h3")]
    assert history.versions_to_append(now, log.unionByName(new), "q").count() == 0
    p = spark.createDataFrame([(1, "h1"), (2, "x"), (3, "h3"), (3, "h3"), (9, "z")], "q int, hash_esperado string")
    got = sorted((r.q, r.resultado) for r in history.apply_if_unchanged(p, now, "q").collect())
    assert got == [(1, "aplicada"), (2, "alterada"), (3, "concorrente"), (3, "concorrente"), (9, "ausente")]


def test_layout_folds(spark):
    w = spark.createDataFrame([(1, 0, k, f"w{k}", float(k), k + 1.0, t, t + 1) for k, t in enumerate([10.0, 13.0, 16.0])], "doc int, page int, n int, text string, x0 double, x1 double, top double, bottom double")
    assert sorted(col(layout.anchored_lines(w, 4.0), "texto")) == ["w0 w1", "w2"]
    assert sorted(col(layout.suppress_near(w, ["doc", "page"], "top", 3.0), "n")) == [0, 2]
    boxes = w.withColumn("confianca", F.lit(0.9))
    assert [(r.n, r.linha) for r in layout.clustered_rows(boxes).orderBy("n").collect()] == [(0, 1), (1, 1), (2, 2)]
    assert layout.anchored_lines(w.where("false"), 4.0).count() == 0


MARKS = "doc int, page int, n int, top double, bottom double, confianca double, c string, _rows int"


def _marks(seed):
    """Pages, one of them unnamed, with equal and missing places; further columns have internal names."""
    rng = random.Random(seed)
    rows = []
    for k in range(300):
        top = rng.choice([None, *[i * 1.5 for i in range(40)]])
        bottom = None if top is None else top + rng.choice([2.0, 10.0, 30.0])
        rows.append((k % 3, rng.choice([0, 1, None]), k // 2, top, bottom, rng.choice([0.5, 0.9]), f"c{k}", k))
    return rows


def _planned(spark, tmp_path, name):
    """The plan of a query over tables that Spark takes for small enough to broadcast."""
    from quaestio.plans import catalog

    spark.createDataFrame([(1, "um dois três")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_suppressed_marks_without_a_join(spark, tmp_path):
    rows, want, last = _marks(3), [], {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0, r[2])):
        kept = last.get(r[:2])
        if r[3] is None or kept is None or abs(kept - r[3]) > 3.0:
            want.append(r[:4])  # of marks with equal place and number any one may stay
            last[r[:2]] = r[3]
    m = spark.createDataFrame(rows, MARKS).repartition(5).withColumn("m", F.create_map(F.lit("k"), F.col("_rows")))
    got = layout.suppress_near(m, ["doc", "page"], "top", 3.0).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
    assert all(r.c == f"c{r._rows}" and r.m == {"k": r._rows} for r in got)
    assert "Join" not in _planned(spark, tmp_path, "suppressed_marks")


def test_clustered_rows_without_a_join(spark, tmp_path):
    rows, want, state = _marks(4), {}, {}
    rows = [(*r[:2], r[7], *r[3:]) for r in rows]
    centre = lambda r: None if r[3] is None else (r[3] + r[4]) / 2
    for r in sorted((r for r in rows if r[5] >= 0.65), key=lambda r: (r[3] is not None, centre(r) or 0, r[2])):
        anchor, k = state.get(r[:2], (None, 0))
        if anchor is None or abs(centre(r) - anchor) > max(4.0, (r[4] - r[3]) / 2):
            anchor, k = centre(r), k + 1
        state[r[:2]], want[r[7]] = (anchor, k), k
    boxes = spark.createDataFrame(rows, MARKS).repartition(5).withColumn("m", F.create_map(F.lit("k"), F.col("_rows")))
    got = layout.clustered_rows(boxes).collect()
    assert {r._rows: r.linha for r in got} == want and len(got) == len(want)
    assert all(r.c == f"c{r._rows}" and r.m == {"k": r._rows} for r in got)
    twice = spark.createDataFrame([(1, 0, 0, 0.0, 10.0, 0.9, "a", 1), (1, 0, 0, 50.0, 60.0, 0.9, "b", 2)], MARKS)
    assert sorted((r.c, r.linha) for r in layout.clustered_rows(twice).collect()) == [("a", 1), ("b", 2)]
    assert "Join" not in _planned(spark, tmp_path, "clustered_rows")


def test_marker_chain_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(40):
        m = [(k, rng.randint(1, 5), rng.randint(0, 1)) for k in range(rng.randint(3, 8))]
        rows += [(doc, *x) for x in m]
        best = 0
        for size in range(len(m), 2, -1):
            if any(all(b[1] == a[1] + 1 for a, b in itertools.pairwise(c)) for c in itertools.combinations(m, size)):
                best = size
                break
        want[doc] = best
    got = layout.marker_chain(spark.createDataFrame(rows, "doc int, n int, numero int, boa int"), "doc").collect()
    for doc, size in want.items():
        chain = sorted((r.n, r.numero) for r in got if r.doc == doc)
        assert len(chain) == size and all(b[1] == a[1] + 1 for a, b in itertools.pairwise(chain))


def test_page_groups_and_detections(spark):
    p = spark.createDataFrame([(1, k, x, s) for k, (x, s) in enumerate([("a", False), ("b", True), ("c", False), ("d", True)])], "doc int, page int, perfil string, forte boolean")
    assert sorted((r.perfil, r.de, r.ate) for r in layout.page_groups(p).collect()) == [("b", 0, 2), ("d", 3, 3)]
    d = spark.createDataFrame([(0.0, 1.0, 0.0, 1.0, 0.5), (1.0, 1.0, 0.0, 1.0, 0.5), (0.0, 1.0, 0.0, float("nan"), 0.5), (0.0, 1.0, 0.0, 1.0, 1.5), (None, 1.0, 0.0, 1.0, 0.5)], "x0 double, x1 double, top double, bottom double, confianca double")
    assert col(d.select(layout.valid_detections().alias("v")), "v") == [True, False, False, False, False]


def _profiles(spark, rows):
    p = documents.profiles(spark.createDataFrame(rows, "id long, tipo string, identificacao_prova string, cargo string, ano int, versao string"))
    return p.where("tipo = 'caderno'"), p.where("tipo = 'gabarito'")


def test_funnel_discards(spark):
    rows = [(1, "caderno", "P1", "Analista de Redes", 2020, "1"), (2, "gabarito", "P1", "Analista de Redes", 2020, "1"), (3, "gabarito", "P2", "Analista de Redes", 2020, "1"), (4, "gabarito", "P1", "Analista de Redes", 2020, "2"), (5, "gabarito", None, None, None, None), (6, "gabarito", "P1", None, None, None)]
    got = {r.gabarito: (r.pontos, r.decisao) for r in documents.candidates(*_profiles(spark, rows)).collect()}
    assert got == {2: (147, "candidato_forte_revisao"), 6: (80, "candidato_revisao")}
    scored = {(r.gabarito, r.eliminado_em) for r in documents._scored(documents._sides(*_profiles(spark, rows))[0].crossJoin(documents._sides(*_profiles(spark, rows))[1])).collect()}
    assert scored == {(2, None), (3, "identificadores"), (4, "modelo_versao"), (5, None), (6, None)}


@pytest.mark.parametrize("pairs", [2_000_000, 3])
def test_funnel_against_all_pairs(spark, monkeypatch, pairs):
    """Candidates, survivors and the five best of every kind of document, against scoring all pairs; frequent keys are salted."""
    monkeypatch.setattr(documents.salted_join, "__defaults__", (None, pairs))
    rng = random.Random(pairs)
    roles = ["Analista de Redes", "Analista de Redes Sênior", "Redes Analista", "Técnico de Som", "Som", "de", "", None, None]
    rows = [
        (k, rng.choice(["caderno", "gabarito", "outro"]), rng.choice(["P1", " p2", "P3", "", None, None]), rng.choice(roles), rng.choice([2019, 2020, None]), rng.choice(["1", "tipo I", "2", None, " "]))
        for k in range(150)
    ]
    left, right = _profiles(spark, rows)
    every = [r.asDict() for r in documents._scored(documents._sides(left, right)[0].crossJoin(documents._sides(left, right)[1])).collect()]
    want = sorted((r["caderno"], r["gabarito"], r["pontos"], r["decisao"]) for r in every if r["decisao"].startswith("candidato"))
    assert sorted(map(tuple, documents.candidates(left, right).collect())) == want and len(want) > 100
    counts = {}
    for r in every:
        c = counts.setdefault(r["caderno"], [0, 0, 0, 0])
        for k, out in enumerate(([], ["identificadores"], ["identificadores", "modelo_versao"], ["identificadores", "modelo_versao", "cargo"])):
            c[k] += r["eliminado_em"] not in out
    assert {r[0]: list(r[1:]) for r in documents.survivors(left, right).collect()} == counts
    best = {}
    for r in sorted((r for r in every if r["eliminado_em"] is None), key=lambda r: (-r["pontos"], r["gabarito"])):
        best.setdefault(r["caderno"], []).append((r["gabarito"], r["pontos"]))
    got = {}
    for r in documents.top_candidates(left, right, 5).orderBy("posicao").collect():
        got.setdefault(r.caderno, []).append((r.gabarito, r.pontos))
    assert got == {k: v[:5] for k, v in best.items()}
    for f in (documents.candidates, documents.survivors):
        assert f(left, right.where("false")).count() == 0 and f(left.where("false"), right).count() == 0


def test_salted_join(spark):
    from quaestio.operators.skew import salted_join

    a = spark.createDataFrame([(k % 3, k) for k in range(60)] + [(9, 1), (None, 2)], "k int, x int")
    b = spark.createDataFrame([(0, k // 2) for k in range(50)] + [(1, 1), (8, 1), (None, 1)], "k int, y int")
    got = sorted((r.k, r.x, r.y) for r in salted_join(a, b, ["k"], None, 20).collect())
    assert got == sorted((i.k, i.x, j.y) for i in a.collect() for j in b.collect() if i.k is not None and i.k == j.k)


def test_search_and_upgrade(spark):
    q = spark.createDataFrame([(1, "O Contrato", True, "x"), (2, "contrato", False, "x"), (3, None, True, "x"), (4, "contrato", True, None)], "id long, enunciado string, ativa boolean, banca string")
    assert col(relational.search(q, "CONTRATO", {"banca": "x", "ano": None}), "id") == [1]
    up = schemas.upgrade(q.withColumn("extra", F.lit(1)), "questoes")
    assert up.columns[: len(schemas.TABLES["questoes"].names)] == schemas.TABLES["questoes"].names and up.columns[-1] == "extra"
    assert relational.with_options(q, spark.createDataFrame([], "questao_id long, letra string, texto string")).where("size(opcoes) = 0").count() == 4


def test_printed_forms(spark):
    from quaestio.operators import printed

    def one(f, t):
        return spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("r")).first().r

    assert one(printed.canonical_format, "Questão Nº 07:\nTexto\nⓐ um\nⓑ dois") == "QUESTÃO 7\nTexto\nA) um\nB) dois"
    assert one(printed.canonical_format, "ⓐ sozinha") == "ⓐ sozinha"
    assert one(printed.canonical_format, "A\num\nB\ndois\nC\ntrês") == "A) um\nB) dois\nC) três"
    assert one(printed.canonical_format, "A) □ um") == "A) um" and one(printed.canonical_format, "A. ☑ um") == "A. um"
    assert one(printed.break_inline_markers, "fim do texto QUESTÃO 12. Nova") == "fim do texto\nQUESTÃO 12. Nova"
    assert one(printed.break_inline_markers, "no parágrafo 7. Depois") == "no parágrafo 7. Depois"
    assert one(printed.break_inline_markers, "A) um B) dois 3. Nova") == "A) um B) dois\n3. Nova"
    assert one(printed.without_front_matter, "Capa\nLíngua Portuguesa\n1. Texto") == "Língua Portuguesa\n1. Texto"
    assert one(printed.without_front_matter, "Capa\nsem título\n1. Texto") == "Capa\nsem título\n1. Texto"
    cells = spark.createDataFrame([(1, ["12", "B"]), (1, ["2026", "A"]), (1, ["13", "X", None]), (1, []), (1, None)], "doc int, celulas array<string>")
    assert sorted((r.numero, r.resposta) for r in printed.cell_pairs(cells).collect()) == [(12, "B"), (13, "X")]
    df = spark.createDataFrame([("a<b", "a>b"), (None, "x")], "a string, b string")
    assert col(df.select(F.pandas_udf(printed.marked_difference, "string")("a", "b").alias("m")), "m") == ["a<del>&lt;</del><ins>&gt;</ins>b", None]


def test_printed_queries_take_stems_as_stored(spark, tmp_path):
    from quaestio.plans import catalog

    stems = ["Nesta questão, avalie.", "Fim do texto QUESTÃO 8. Nova", "Marque a) um b) dois 3. Outra", " com  brancos ", "Água a 10 %: x", "o texto", "o texto\n2. Outra", None]
    spark.createDataFrame(list(enumerate(stems)), "id long, enunciado string").write.parquet(f"{tmp_path}/questoes.parquet")
    run = lambda name: {r.id: r.texto for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    last, cover = "\nQUESTÃO 9. Outra pergunta", "Leia as instruções\n01 - não vire\n"
    broken = {1: "Fim do texto\nQUESTÃO 8. Nova", 2: "Marque a) um b) dois\n3. Outra", 3: " com  brancos"}
    assert run("inline_marker_break") == {k: t and broken.get(k, t) + last for k, t in enumerate(stems)}
    # a marker is a number before a capital, so covers of stems that begin otherwise stay
    assert run("front_matter_removed") == {k: t and cover * (k in (3, 5)) + "Atualidades\n1. " + t for k, t in enumerate(stems)}


def test_ordered_anchor(spark, tmp_path):
    from quaestio.plans import catalog

    item = "O contador do município examinou as contas anuais da autarquia federal em detalhe"
    texts = {
        1: "O CONTADOR do muni-\ncípio examinou as contas anuais da autarquia", 2: "O contadur do municlplo examinou as contas anuais da autarquia", 3: "7 x O contador do município examinou as contas anuais da autarquia",
        4: "O contador a do município b examinoo as contas anuais da autarquia", 5: "O contador a do b município c examinoo as contas anuais da autarquia", 6: "O contador da município examinou as contas anuais da autarquia",
        7: "O do contador município examinou as contas anuais da autarquia", 8: f"{'z ' * 50}{item}", 9: f"{'z ' * 51}{item}", 10: "O contador do município examinou as contas anuais", 11: None, 12: "", 13: "curta demais", 14: "a b c O contadur do município examinou as contas anuais da autarquia",
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "curta demai"), (3, None)], "item_id long, texto string").write.parquet(f"{tmp_path}/itens_avaliacao.parquet")
    got = {(r.id, r.ref_id): r.ancora for r in catalog.queries()["ordered_anchor"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): "exata", (2, 1): "aproximada", (3, 1): "exata", (4, 1): "aproximada", (8, 1): "exata"}


def test_fuzzy_names_in_any_script_and_first_letter(spark, tmp_path):
    from quaestio.plans import catalog

    spark.createDataFrame([(1, "Lnglês"), (2, "Inglêsж"), (3, "inglês"), (4, ""), (5, None), (6, "Ingxxxs")], "id long, disciplina string").write.parquet(f"{tmp_path}/questoes.parquet")
    spark.createDataFrame([(7, "disciplina", "Inglês")], "ref_id long, campo string, nome string").write.parquet(f"{tmp_path}/lista_canonica.parquet")
    assert {tuple(r) for r in catalog.queries()["fuzzy_anchor"](spark, str(tmp_path)).collect()} == {(1, 7, 1), (2, 7, 1)}
