"""Operators against brute force, exact round trips and held-out cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestio.llm import p01_signature_tree as p1
from quaestio.llm import p02_confusables as p2
from quaestio.llm import p03_encoding as p3
from quaestio.llm import p04_canonical as p4
from quaestio.llm import p05_scans as p5
from quaestio.llm import p06_copies as p6
from quaestio.llm import p07_truncated as p7
from quaestio.llm import p08_leaks as p8
from quaestio.llm import p09_mixture as p9
from quaestio.llm import p10_personal as p10
from tests.llm.helpers import bank

NOUNS = "orçamento relatório contrato edital acervo inventário cadastro estoque balanço convênio parecer laudo mandado registro tributo censo mapa plano recurso projeto".split()
VERBS = "analisou revisou aprovou contestou financiou homologou interpretou monitorou ordenou planejou reabriu reduziu retificou suspendeu transferiu".split()
ADJECTIVES = "anual mensal regional municipal estadual vigente pendente parcial integral final inicial original formal digital ambiental".split()
WHO = "o síndico,a geóloga,o instrutor,a equipe técnica,o pregoeiro,a procuradoria,o tesoureiro,a bibliotecária".split(",")
HOW = "em caráter irrevogável,sob pena de nulidade,por falta de quórum,em solo argiloso,com juros compostos,à revelia do interessado,no âmbito da autarquia".split(",")


def sentence(rng):
    return f"{rng.choice(WHO)} {rng.choice(VERBS)} o {rng.choice(NOUNS)} {rng.choice(ADJECTIVES)} {rng.choice(HOW)}"


def text(rng, n=3):
    return ". ".join(sentence(rng).capitalize() for _ in range(n)) + "."


# ---- 1


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 25 else None


@pytest.mark.parametrize("cell", [8192, 8])
def test_near_duplicates_are_exact(spark, monkeypatch, cell):
    """Every pair is found, also where one block holds most rows and is divided into cells."""
    monkeypatch.setattr(p1, "CELL", cell)
    rng = random.Random(cell)
    base = [text(rng, 4) for _ in range(25)]
    rows = list(base)
    for _ in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [rng.choice(NOUNS)] * rng.randint(0, 2)
        rows.append(" ".join(w))
    rows += [base[0]] * 12 + ["curto", None, ""]
    members, similar = p1.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "i long, t string"), "i", "t")
    rep = {r.id: r.rep for r in members.collect()}
    links = {(r.a, r.b) for r in similar.collect()} | {(r.b, r.a) for r in similar.collect()}
    sets = [(i, s) for i, t in enumerate(rows) if t and (s := shingles(t))]
    n = 0
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            want = 2 * len(x & y) >= len(x | y)
            n += want
            assert (rep[i] == rep[j] or (rep[i], rep[j]) in links) == want
    assert n > 100


def test_signature_tree_drops_no_pair():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(700)]
    size = np.array([len(r) for r in rows])
    h = np.concatenate(rows) * 0x1E3779B97F4A7C15
    sig = p1._bitmaps(np.repeat(np.arange(len(rows)), size), h.astype(np.int64), len(rows))
    a, b = p1.SignatureTree(size[:450], sig[:450]), p1.SignatureTree(size[450:], sig[450:])
    own = {tuple(sorted(p)) for i, j in p1.dual_traversal(a, None, 1, 2) for p in zip(i.tolist(), j.tolist(), strict=True)}
    cross = {(i, j + 450) for x, y in p1.dual_traversal(a, b, 1, 2) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(450):
        for j in range(i + 1, 700):
            if 2 * len(np.intersect1d(rows[i], rows[j])) >= len(np.union1d(rows[i], rows[j])):
                assert (i, j) in (own if j < 450 else cross)


# ---- 2


def test_confusables():
    assert p2.consistent("ａpontｅ  a opção​ ﬁnal") == "aponte  a opção final"
    assert p2.consistent("оpção do сontratο, «правда» e π") == "opção do contrato, «правда» e π"
    assert p2.consistent("opção") == "opção"
    assert p2.kinds("Nº 1ª m² ½ … – “x” правда Ω\t\n") == []
    assert p2.kinds("ｘ") == ["largura"] and p2.kinds("á") == ["acento"] and p2.kinds("a b") == ["espaco"]
    assert p2.kinds("ﬁ") == ["ligadura"] and p2.kinds("a⁠b") == ["invisivel"] and p2.kinds("Lagοa") == ["alfabeto"]
    assert p2.skeleton("оpção ﬁxa") == p2.skeleton("opção fixa") and p2.skeleton("Il1|0") == p2.skeleton("lIlIO")
    for t in ("", "texto", "ＡＢＣ", "á​"):
        assert p2.consistent(p2.consistent(t)) == p2.consistent(t)


# ---- 3


def test_every_chain_inverts():
    for name in p3.CHAINS:
        for t in ("ação", "É órgão", "texto", "“não” – à"):
            if (g := p3.garble(t, name)) is not None:
                assert p3.invert(g, name) == t


def test_held_out_garbling():
    """A model of some texts restores the garbled words of others, and leaves clean words and traps alone."""
    rng = random.Random(7)
    detector = p3.Detector(p3.train([text(rng) for _ in range(400)] + ["ångström 5 °C, m² – “Ω”, «правда»"] * 4))
    held = [text(rng) for _ in range(150)]
    for name in ("utf8>latin1", "utf8>cp1252 x2", "utf8>cp850", "utf8>mac", "latin1>cp850"):
        right = total = 0
        for t in held:
            words = [w for w in t.split() if not w.isascii()]
            garbled = " ".join(p3.garble(w, name) if w in words else w for w in t.split())
            out = garbled
            for s, e, _, original, _ in reversed(detector.spans(garbled)):
                out = out[:s] + original + out[e:]
            total += len(words)
            right += sum(a == b for a, b in zip(out.split(" "), t.split(), strict=False) if not b.isascii())
        assert right >= 0.97 * total, (name, right, total)
    assert sum(any(sure for *_, sure in detector.spans(t)) for t in held) == 0


def test_restored_text(spark, tmp_path):
    rng = random.Random(1)
    clean = [text(rng) for _ in range(80)]
    bad = {1: p3.garble(clean[0], "utf8>latin1"), 2: clean[1][:30] + p3.garble(clean[1][30:], "utf8>cp850"), 3: clean[2].replace("ã", "?"), 4: re.sub("[ãçõéí]", "�", clean[3]), 5: "O que é isso?Resposta: 3 ± ½ µ"}
    rows = [(k, bad.get(k, t), None, None, None, None, None) for k, t in enumerate(clean, 1)]
    folder = bank(spark, tmp_path, questoes=rows)
    got = {r.registro_id: r.texto_restaurado for r in p3.p3_restored(spark, folder).collect()}
    assert {1, 2, 4} <= set(got) <= {1, 2, 3, 4}
    assert got[1] == clean[0] and got[2] == clean[1]
    assert sum(got[4].split()[k] == w for k, w in enumerate(clean[3].split())) >= len(clean[3].split()) - 1


# ---- 4

NAMES = ["Língua Portuguesa", "Direito Penal", "Direito Processual Penal", "Agente Administrativo I", "Agente Administrativo II", "Escriturário", "Matemática Financeira"]


@pytest.mark.parametrize(
    "typed,want",
    [
        ("LINGUA PORTUGUESA", 0), (" Língua  Portuguesa. ", 0), ("Lígnua Portguesa", 0), ("Portuguesa, Língua", 0), ("PROVA DE LÍNGUA PORTUGUESA", 0), ("Líng. Port.", 0),
        ("Direito Peanl", 1), ("Direito Penal / Conhecimentos Específicos", 1), ("Direito Proc. Penal", 2), ("agente administrativo 1", 3), ("CARGO: Agente Administrativo - II", 4),
        ("Esc.", 5), ("Matemática Financeira (20 questões)", 6), ("Língua Guarani", None), ("Direito Espacial", None), ("n/d", None), ("???", None), ("Agente Funerário", None),
    ],
)
def test_typed_names(spark, typed, want):
    canon = spark.createDataFrame([(k + 1, "cargo", n, None) for k, n in enumerate(NAMES)], "ref_id long, campo string, nome string, sigla string")
    df = spark.createDataFrame([(1, None, None, typed)], "id long, disciplina string, banca string, cargo string")
    assert [r.ref_id for r in p4.mapped(df, canon).collect()] == [0 if want is None else want + 1]


def test_set_join_is_exact(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    left = [(k, "p", sorted(set(rng.choices(words[:25], k=rng.randint(1, 8))))) for k in range(120)]
    right = [(k, rng.choice("pq"), sorted(set(rng.choices(words[:25], k=rng.randint(1, 8))))) for k in range(120)]
    schema = "id int, part string, grams array<string>"
    got = {(r.l, r.r) for r in p4.set_similarity_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 2, 5).collect()}
    want = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and 5 * len(set(a[2]) & set(b[2])) >= 2 * len(set(a[2]) | set(b[2]))}
    assert got == want and want


def test_abbreviations_without_a_cap(spark):
    """Seven abbreviations, each of several words of the list, and a name behind six other words."""
    names = [" ".join(f"{a}{w}" for a in "bcdfghj") for w in ("ala", "ela", "ila", "ola", "ula", "ata", "eta", "ita")]
    canon = spark.createDataFrame([(k + 1, "cargo", n, None) for k, n in enumerate(names)], "ref_id long, campo string, nome string, sigla string")
    typed = ["b. c. d. f. g. h. jita", "um dois três quatro cinco seis bola cola dola fola gola hola jola"]
    df = spark.createDataFrame([(k, None, None, t) for k, t in enumerate(typed)], "id long, disciplina string, banca string, cargo string")
    assert {r.questao_id: r.ref_id for r in p4.mapped(df, canon).collect()} == {0: 8, 1: 4}


def test_hot_value(spark):
    df = spark.createDataFrame([(k, "Direito Peanl" if k % 3 else f"x{k}") for k in range(6000)], "id long, disciplina string").withColumn("banca", F.lit(None).cast("string")).withColumn("cargo", F.lit(" "))
    canon = spark.createDataFrame([(9, "disciplina", "Direito Penal", None)], "ref_id long, campo string, nome string, sigla string")
    assert Counter(r.ref_id for r in p4.mapped(df, canon).collect()) == {9: 4000, 0: 2000}


# ---- 5


def weighted(seen, word):
    """The cost of reading ``word`` as ``seen``, by plain dynamic programming."""
    n, m = len(seen), len(word)
    d = [[99.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                d[i][j] = 0.0
                continue
            c = []
            if i:
                c.append(d[i - 1][j] + p5.OTHER)
            if j:
                c.append(d[i][j - 1] + p5.OTHER)
            if i and j:
                s, t = seen[i - 1], word[j - 1]
                c.append(d[i - 1][j - 1] + (0 if s == t else 1 if t in p5.DIGITS.get(s, "") else p5.OTHER))
                if i > 1 and p5.MERGES.get(seen[i - 2 : i]) == t:
                    c.append(d[i - 2][j - 1] + 1)
                if j > 1 and p5.SPLITS.get(s) == word[j - 2 : j]:
                    c.append(d[i - 1][j - 2] + 1)
            d[i][j] = min(c)
    return d[n][m]


def test_trie_retrieves_all():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("amnrcdlo") for _ in range(rng.randint(2, 7))) for _ in range(500)})
    trie = p5.Trie(words)
    for _ in range(150):
        seen = "".join(rng.choice("amnrcdlo015") for _ in range(rng.randint(1, 7)))
        want = {w: round(c, 6) for w in words if (c := weighted(seen, w)) <= 2.2}
        assert {w: round(c, 6) for w, c in trie.within(seen, 2.2)} == want


def test_furniture_in_capitals():
    loud = "A EQUIPE ANALISOU O CONTRATO\n- 12 -\nE A COMISSÃO APROVOU O LAUDO 20"
    assert [loud[s:e] for s, e in p5.furniture(loud)] == ["- 12 -"]


def test_scan_noise(spark, tmp_path):
    rng = random.Random(8)
    clean = [text(rng, 5) for _ in range(120)]
    t = clean[0]
    at, cut = t.index(" ", 40), clean[6].index(" ", 60)
    noisy = {
        1: t[:at] + "\nPágina 3 de 20\n" + t[at + 1 :], 2: clean[1].replace("relatório", "relatóri0").replace("contrato", "c0ntrato").replace("edital", "ed1tal"),
        3: re.sub("(sus|trans|mo|re)(pendeu|feriu|nitorou|visou|duziu|tificou|abriu)", r"\1-\n\2", clean[2], count=1), 4: "I – o mapa;\nII – o plano;\nIII – o laudo.", 5: "Use IPv6, H2O e B12 na sala 3.",
        6: clean[5].replace(" ", "\n", 9), 7: clean[6][:cut] + " CADERNO DE QUESTÕES | TIPO 2 | MANHÃ  19 " + clean[6][cut + 1 :],
    }
    rows = [(k, noisy.get(k, x), None, None, None, None, None) for k, x in enumerate(clean, 1)]
    folder = bank(spark, tmp_path, questoes=rows)
    found = {r.registro_id for r in p5.p5_found(spark, folder).collect()}
    want = {1, 7} | {k for k in (2, 3) if noisy[k] != clean[k - 1]}
    assert found == want
    fixed = {r.registro_id: r.texto_reparado for r in p5.p5_repaired(spark, folder).collect()}
    for k in want:
        assert " ".join(fixed[k].split()) == clean[k - 1], k


# ---- 6


def test_copies(spark, tmp_path):
    a = "A equipe técnica analisou o orçamento anual em solo argiloso."
    q = [(1, a, None), (2, a.upper() + " !!", ""), (3, "  " + a.replace(" ", "  "), "X"), (4, a, "x."), (5, "curta", None), (6, "curta", None), (7, a.replace("ç", "c"), None)]
    raw = [(1, '{"Banca":"A", "ano": 2020}'), (2, '{ "ANO" : "2.020" , "banca":"a" }'), (3, '{"banca":"a"}'), (4, '{"banca":"a","ano":null}'), (5, '{"ano":"","banca":"\\u0041"}'), (6, "no json"), (7, "NO JSON!")]
    folder = bank(spark, tmp_path, questoes=[(i, e, None, None, b, None, None) for i, e, b in q], importacoes_brutas=[(i, "f", r) for i, r in raw])
    got = sorted((r.origem[0], r.registro_id, r.grupo_id) for r in p6.p6_found(spark, folder).collect())
    assert got == [("i", 1, 1), ("i", 2, 1), ("i", 4, 4), ("i", 5, 4), ("i", 6, 6), ("i", 7, 6), ("q", 1, 1), ("q", 2, 1), ("q", 3, 3), ("q", 4, 3)]


def test_hot_copies(spark):
    """A key of a third of all rows takes the salted way and gives the same result."""
    rows = [(k, "hot" if k % 3 == 0 else f"k{k % 997}") for k in range(9000)]
    keyed = spark.createDataFrame(rows, "registro_id long, chave string").withColumn("v", F.col("registro_id") * 2)
    groups = defaultdict(list)
    for i, k in rows:
        groups[k].append(i)
    assert [r.chave for r in p6.hot_keys(keyed).collect()] == ["hot"]
    got = {r.registro_id: (r.v, r.copias) for r in p6.collapse(keyed, ["v"]).collect()}
    assert got == {min(g): (2 * min(g), len(g)) for g in groups.values()}
    assert {(r.registro_id, r.grupo_id) for r in p6.members(keyed).collect()} == {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


# ---- 7


def test_truncated(spark, tmp_path):
    rng = random.Random(9)
    q, links, cut = [], [], set()
    for k in range(1, 601):
        t = text(rng, 4)
        source = k % 10
        if source == 3 and len(t) > 150:
            t = t[:150]
            cut.add(k)
        elif k % 41 == 0:
            words = t.split()
            n = rng.randint(6, len(words) - 3)
            t = " ".join(words[:n])[:-2] + rng.choice(["…", "...", ""])
            cut.add(k)
        elif k % 7 == 0:
            t = t[:-1]  # without its final stop only
        q.append((k, t, None, None, None, None, "certo_errado"))
        links.append((source + 1, k, k))
    folder = bank(spark, tmp_path, questoes=q, prova_cadastrada_questoes=links, provas_cadastradas=[(s + 1, s + 100) for s in range(10)])
    found = {r.registro_id for r in p7.p7_found(spark, folder).collect()}
    hit = len(found & cut)
    assert hit >= 0.9 * len(cut) and hit >= 0.9 * len(found), (len(cut), len(found), hit)
    rate = {r.documento_fonte_id: r.taxa for r in p7.p7_rates(spark, folder).collect()}
    assert rate[103] > 0.8 and max(v for s, v in rate.items() if s != 103) < 0.2


def test_truncated_copies(spark, tmp_path):
    """Copies of all tables with shifted keys change nothing, also where a question has no source or several equal options."""
    rng = random.Random(21)
    q, a, links = [], [], []
    for k in range(1, 301):
        t = text(rng, 4)
        if k % 23 == 0:
            words = t.split()
            t = " ".join(words[: rng.randint(6, len(words) - 3)])[:-2]
        q.append((k, t, None, None, None, None, None))
        o = text(rng, 1)
        a += [(3 * k, k, "A", o), (3 * k + 1, k, "B", o), (3 * k + 2, k, "C", text(rng, 1)[: -4 if k % 29 == 0 else None])]
        if k % 10:
            links.append((k % 10, k, k))

    def found(copies):
        def all_of(rows, *keys):
            return [tuple(v + 10_000 * c if i in keys and v is not None else v for i, v in enumerate(r)) for c in range(copies) for r in rows]

        sources = [(s, s + 100) for s in range(10)]
        folder = bank(spark, tmp_path / str(copies), questoes=all_of(q, 0), alternativas=all_of(a, 0, 1), prova_cadastrada_questoes=all_of(links, 0, 1), provas_cadastradas=all_of(sources, 0, 1))
        return {(r.campo, r.registro_id) for r in p7.p7_found(spark, folder).collect()}

    once = found(1)
    assert {f for f, _ in once} == {"questoes.enunciado", "alternativas.texto"}
    assert found(6) == {(f, i + 10_000 * c) for f, i in once for c in range(6)}


def test_cut_within_the_same_word(spark, tmp_path):
    """Different values cut within the same word after the same words, as in large banks, are no evidence for each other."""
    whole = [f"O ensaio {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvxz'[k // 100]} foi feito em solo argiloso." for k in range(400)]
    cut = ["A comissão pediu um ensaio em solo argil", "O perito mediu a umidade em solo argil", "Houve recalque em solo argil"]
    end = ["A obra fica em solo arenoso", "O poço fica em solo arenoso"]  # only without its final stop
    texts = [*whole, *cut, *end]
    folder = bank(spark, tmp_path, questoes=[(k, t, None, None, None, None, None) for k, t in enumerate(texts)])
    assert {texts[r.registro_id] for r in p7.p7_found(spark, folder).collect()} == set(cut)


def test_tails_by_prefix(spark, monkeypatch):
    """Uses of the words that begin with a tail, against a loop; some words are longer than all prefixes are counted of."""
    monkeypatch.setattr(p7, "LONG_WORD", 3)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
    known = {(rng.choice("xy"), word()): tuple(rng.randint(0, 5) for _ in range(3)) for _ in range(120)}
    mine = {(rng.choice("xyz"), word()) for _ in range(60)}
    k = spark.createDataFrame([(c, w, *n) for (c, w), n in known.items()], "w1 string, outra string, vai long, para long, fim long")
    got = {(r.w1, r.w): (r.vai1, r.para1, r.longas1) for r in p7._prefix_uses(spark.createDataFrame(sorted(mine), "w1 string, w string"), k, ["w1"], 1).collect()}
    for c, w in mine:
        met = {o: n for (x, o), n in known.items() if x == c and o.startswith(w)}
        own = met.get(w, (0, 0, 0))
        assert got.get((c, w), (0, 0, 0)) == (own[0], own[1] + own[2], sum(sum(n) for o, n in met.items() if o != w))


def test_continued_texts(spark):
    f = spark.createDataFrame([("a", "um dois"), ("a", "um dois três"), ("a", "um doisé"), ("b", "um"), ("b", "dois"), ("a", "zz")], "campo string, f string")
    assert sorted(map(tuple, p7.continued(f).collect())) == [("a", "um dois")]


# ---- 8


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (60, p8.WINDOW)), rng.integers(0, 4, (60, p8.WINDOW))
    assert p8.edit_distances(a, b).tolist() == [levenshtein(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_leaks_and_recall(spark):
    """Unedited passages are all found; edited ones with a recall of at least 0.9 of brute force, by item and document."""
    rng = random.Random(11)
    vocab = [f"{a}{b}{k}" for k in range(30) for a in ("ba", "ço", "té") for b in ("ra", "nha")]
    items = [(k, " ".join(rng.choices(vocab, k=40))) for k in range(30)]
    docs, plain, edited = [], [], set()
    for k in range(240):
        w = rng.choices(vocab, k=60)
        i, t = items[k % 30]
        part = t.split()[5:30]
        if k % 3 == 0:
            w[20:20] = part[: 12 + k % 10]
        elif k % 3 == 1:
            part[::9] = [rng.choice(vocab) for _ in part[::9]]
            w[20:20] = part
            edited.add((k, i))
        plain.append(w)
        docs.append((k, " ".join(w).upper() if k % 2 else ", ".join(w)))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, texto string")
    runs = lambda w: {tuple(w[a : a + 12]) for a in range(len(w) - 11)}
    exact = {(k, j) for k, w in enumerate(plain) for j, t in items if runs(w) & runs(t.split())}
    found = {(r.doc_id, r.item_id): r for r in p8.leaked(d, i).collect()}
    assert set(found) == exact and len(exact) >= 80
    assert all(found[k, k % 30].palavras_seguidas >= 12 + k % 10 for k in range(0, 240, 3))
    near = {(r.doc_id, r.item_id) for r in p8.leaked(d, i, p8.MAX_EDITS).collect()}
    assert exact <= near and len(near & edited) >= 0.9 * len(edited)


def test_recall_of_single_windows(spark):
    """Two edits in passages of 12 to 14 words, wherever they are: nine of ten windows that brute force finds."""
    rng = random.Random(17)
    word = lambda: f"p{rng.randrange(10**9)}"
    items, docs = [], []
    for size in (12, 13, 14):
        for a, b in itertools.combinations(range(size), 2):
            for kinds in ("ss", "s-", "+s", "i"):
                k, part = len(items), [word() for _ in range(size)]
                items.append((k, " ".join(part)))
                if kinds == "i":
                    part.insert(a, word())
                for at, kind in ((b, kinds[-1]), (a, kinds[0])):
                    if kind == "s":
                        part[at] = word()
                    elif kind == "-":
                        del part[at]
                    elif kind == "+":
                        part.insert(at, word())
                docs.append((k, size, kinds, [word() for _ in range(14)] + part + [word() for _ in range(14)]))
    found = {r.doc_id: r.janelas for r in p8.leaked(spark.createDataFrame([(k, " ".join(w)) for k, _, _, w in docs], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, texto string"), p8.MAX_EDITS).collect()}

    def windows(w):
        return np.lib.stride_tricks.sliding_window_view(p8.word_hashes(" ".join(w), {}), p8.WINDOW)

    true, got = Counter(), Counter()
    for k, size, kinds, w in docs:
        d, i = windows(w), windows(items[k][1].split())
        near = p8.edit_distances(np.repeat(d, len(i), 0), np.tile(i, (len(d), 1))).reshape(len(d), -1).min(1) <= p8.MAX_EDITS
        assert found.get(k, 0) <= near.sum()
        true[size, kinds] += int(near.sum())
        got[size, kinds] += found.get(k, 0)
    assert true[12, "ss"] >= 60 and {s for s, _ in got} == {12, 13, 14}
    assert {c: got[c] / n for c, n in true.items() if n >= 60 and got[c] < 0.9 * n} == {}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p8, "ITEM_BLOCK", 7)
    words = [" ".join(f"w{k}x{j}" for j in range(15)) for k in range(30)]
    i = spark.createDataFrame(list(enumerate(words)), "item_id long, texto string")
    d = spark.createDataFrame([(k, f"antes {t} depois") for k, t in enumerate(words)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in p8.leaked(d, i).collect()} == {(k, k) for k in range(30)}


# ---- 9


@pytest.mark.parametrize("buckets", [4, 1024])
def test_mixture_against_queue(spark, monkeypatch, buckets):
    monkeypatch.setattr(p9, "BUCKETS", buckets)
    rng = random.Random(12)
    rows = [(k, rng.choice("aaab") if k % 9 else "c", rng.randint(1, 50)) for k in range(600)] + [(900, None, 5), (901, "z", 5), (902, "a", 0)]
    goals = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    g = spark.createDataFrame(goals, "source string, parcela_alvo double, max_repeticoes int")
    hashed = {(i, c): int(hashlib.md5(f"{p9.SEED}|{i}|{c}".encode()).hexdigest()[:15], 16) for i, _, _ in rows for c in (1, 2, 3)}
    have = Counter()
    for _, s, t in rows:
        have[s] += t
    total = min(int(have[s] * cap / w) for s, w, cap in goals)
    queue = []
    for s, w, cap in goals:
        mine = sorted((c, hashed[i, c], i, t) for i, x, t in rows if x == s and t for c in range(1, cap + 1))
        done = 0
        for c, _, i, t in mine:
            done += t
            queue.append((done / w, s, i, c, t))
    want, at = [], 0
    for v, s, i, c, t in sorted(queue):
        at += t
        if at > total:
            break
        want.append((i, c))
    chosen = p9.mix(df, g)
    got = [(r.doc_id, r.copia) for r in chosen.orderBy("tokens_ate_aqui").collect()]
    assert got == want
    share = {r.source: r for r in p9.shares(chosen, g).collect()}
    assert all(abs(share[s].parcela_obtida - w) < 0.02 and share[s].max_copias <= cap for s, w, cap in goals)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Olá, mundo", "a"), (2, None, "a"), (3, "", None)], "doc_id long, text string, source string")
    got = {r.doc_id: r.tokens for r in p9.count_tokens(df, "doc_id", "text", ["source"]).collect()}
    assert p9.encoder(p9.TOKENIZER) is not None and got == {1: len(p9.encoder(p9.TOKENIZER).encode_ordinary("Olá, mundo")), 3: 0}


# ---- 10

TEXT = (
    "Sr. Davi Vicente M. Hortemar, CPF 994.128.846-86, residente na Praça da Olaria, nº 728, fone (52) 91508-2745 ou davi (arroba) mail.example. "
    "Recurso de PESTORRA, Antônio (RG QX-99.327.126). A pedido de Mauro e Davi, o perfil @concurso_1 saiu. Processo 8846129-61.2010.8.99.0041, protocolo 2024183691, "
    "CNPJ 00.250.151/0001-43, ISBN 000-00-5919-175-7, Lei nº 9.688/1974; a obra da Rua do Farol parou entre 2005-2014. Davi Vicente M. Hortemar voltou."
)


def test_personal_items():
    got = [(k, TEXT[s:e]) for s, e, k in p10.find(TEXT)]
    assert got == [
        ("nome", "Davi Vicente M. Hortemar"), ("documento", "994.128.846-86"), ("endereco", "Praça da Olaria, nº 728"), ("telefone", "(52) 91508-2745"),
        ("email", "davi (arroba) mail.example"), ("nome", "PESTORRA, Antônio"), ("documento", "QX-99.327.126"), ("nome", "Davi Vicente M. Hortemar"),
    ]
    marked = p10.masked(TEXT, p10.find(TEXT))
    assert marked.startswith("Sr. [NOME_1], CPF [DOCUMENTO_1], residente na [ENDERECO_1], fone [TELEFONE_1] ou [EMAIL_1].") and marked.endswith("[NOME_1] voltou.")


@pytest.mark.parametrize(
    "text,names",
    [
        ("MARIA SILVA SOUZA COSTA PEREIRA LIMA ROCHA DIAS compareceu", ["MARIA SILVA SOUZA COSTA PEREIRA LIMA ROCHA DIAS"]),
        ("Maria Aparecida dos Santos Oliveira e José Carlos de Almeida Souza vieram", ["Maria Aparecida dos Santos Oliveira", "José Carlos de Almeida Souza"]),
        ("presentes MARIA LIMA, ANA SOUZA e outros", ["MARIA LIMA", "ANA SOUZA"]), ("o servidor, Zuleica Batista, saiu", ["Zuleica Batista"]),
        ("recurso de Jonatas Pires contra", ["Jonatas Pires"]), ("Zuleica Ortiga, CPF 123.456.789-00, mora", ["Zuleica Ortiga"]), ("na cidade de Campo Silva", []),
        ("A PORTARIA EM RAZÃO DA CHUVA INTENSA NOVAMENTE SÔNIA PUBLICOU SOMENTE A PORTARIA Quando", []), ("candidata" + " " * 90 + "Zuleica Ortiga", ["Zuleica Ortiga"]),
    ],
)
def test_names_without_the_list(text, names):
    assert [text[s:e] for s, e, k in p10.find(text) if k == "nome"] == names


def test_surrogates_are_nobody(spark):
    """No surrogate is a real entity of its type: with nearly all of a short format taken, what is left over is marked."""
    rows = [("documento", f"{k:02d}") for k in range(80)]
    got = p10.surrogates(spark.createDataFrame(rows, "tipo string, chave string"), "k").collect()
    new = [r.substituto for r in got]
    assert len(set(new)) == 80 and not set(new) & {k for _, k in rows}


def test_surrogates(spark):
    """Distinct entities stay distinct, equal ones equal; types, scripts and formats stay."""
    rows = [("nome", f"{g} {s}{k}") for g in ("ana", "paulo") for s in ("prado", "mota") for k in range(60)] + [("documento", str(k)) for k in range(10)] + [("telefone", f"2199{k:07d}") for k in range(200)]
    df = spark.createDataFrame(rows + rows, "tipo string, chave string")
    got = p10.surrogates(df, "k").collect()
    assert len(got) == len(rows) and len({(r.tipo, r.substituto) for r in got}) == len(rows)
    first = {r.chave: r.substituto.split()[0] for r in got if r.tipo == "nome"}
    assert all((v in p10.WOMEN) == k.startswith("ana") for k, v in first.items())
    assert {(r.tipo, r.chave, r.substituto) for r in p10.surrogates(df, "k").collect()} == {(r.tipo, r.chave, r.substituto) for r in got}
    new = p10.dressed("+55 (29) 9 1264-4064", "telefone", p10.draw("k", "telefone", "29912644064", 0))
    assert re.fullmatch(r"\+55 \([1-9]{2}\) 9 \d{4}-\d{4}", new) and "(29)" not in new
    assert p10.dressed("PESTORRA, Antônio", "nome", "paulo rubezi") == "RUBEZI, Paulo"
