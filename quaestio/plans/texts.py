"""Queries over text: normal forms, lookups, headings, key documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestio.functions import catalogs as C
from quaestio.functions import text as X
from quaestio.operators import keytext as K
from quaestio.operators.linkage import merge_observations
from quaestio.plans.registry import Registry
from quaestio.session import table

query = Registry()


@query(r"""SELECT id, trim(regexp_replace(replace(lower(regexp_replace(enunciado, '(\p{L})-\s*\n\s*(\p{L})', '\1\2', 'g')), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS normal FROM questoes""")
def text_compare_norm(spark, d):
    """Stems in their form for comparing."""
    return table(spark, d, "questoes").select("id", X.comparison_text(F.col("enunciado")).alias("normal"))


@query()
def page_normalized(spark, d):
    """Documents as pages in compatible composed form, which SQL here can't give."""
    return table(spark, d, "documents").select("doc_id", X.page_normal(F.col("text")).alias("pagina"))


_ACC = f"trim(regexp_replace(lower(translate({{}}, '{X.ACCENTED}', '{X.PLAIN}')), '\\s+', ' ', 'g'))"


@query(f"SELECT id, {_ACC.format('cargo')} AS chave FROM questoes WHERE cargo IS NOT NULL")
def accent_key(spark, d):
    """Roles without accents, case and repeated blanks."""
    return table(spark, d, "questoes").where("cargo IS NOT NULL").select("id", X.accent_key(F.col("cargo")).alias("chave"))


@query(r"""SELECT id, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(texto_apoio, chr(160), ' '), '(\p{L})-[ \t]*\n[ \t]*(\p{Ll})', '\1\2', 'g'), chr(10)),
lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^[A-Za-z0-9+/=]{40,}$') AND NOT regexp_matches(x, '(?i)^(?:pcimarkpci|www\.)\S*$')), chr(10)) AS pagina
FROM questoes WHERE texto_apoio IS NOT NULL""")
def page_clean(spark, d):
    """Support texts as clean pages."""
    return table(spark, d, "questoes").where("texto_apoio IS NOT NULL").select("id", X.clean_page(F.col("texto_apoio")).alias("pagina"))


_REPAIR = (("l[�i]ngua", "lingua"), ("inform[�a]tica", "informatica"), ("racioc[�i]nio", "raciocinio"), ("matem[�a]tica", "matematica"), ("quest[�a]o", "questao"), ("quest[�a]es", "questoes"))


def _repair_sql(column: str) -> str:
    for a, b in _REPAIR:
        column = f"regexp_replace({column}, '(?i){a}', '{b}', 'g')"
    return column


@query(f"SELECT id, {_repair_sql('enunciado')} AS reparado FROM questoes WHERE contains(enunciado, '�')")
def ocr_replacement_repair(spark, d):
    """Six words that lost a letter to the replacement sign."""
    c = F.col("enunciado")
    for a, b in _REPAIR:
        c = F.regexp_replace(c, f"(?i){a}", b)
    return table(spark, d, "questoes").where(F.contains("enunciado", F.lit("�"))).select("id", c.alias("reparado"))


@query("SELECT id, trim(regexp_replace(enunciado, '\\s+', ' ', 'g')) AS linha FROM questoes")
def joined_lines(spark, d):
    """Stems on one line."""
    return table(spark, d, "questoes").select("id", X.squeeze(F.col("enunciado")).alias("linha"))


@query(f"""WITH o AS (SELECT questao_id, string_agg('(' || letra || ') ' || replace(texto, chr(10), ' '), ' ' ORDER BY letra, id) AS linha FROM alternativas WHERE letra IN ('A','B','C','D','E') GROUP BY 1),
l AS (SELECT *, regexp_extract_all(linha, '{X.OPTION_LETTER}', 1) AS x FROM o)
SELECT questao_id, CASE WHEN len(x) >= 2 AND list_transform(x, lambda c: upper(c)) = list_sort(list_distinct(list_transform(x, lambda c: upper(c)))) AND len(list_distinct(list_transform(x, lambda c: c = upper(c)))) = 1
 THEN regexp_replace(linha, '{X.OPTION_SIGN}', '\\1' || chr(10) || '\\2', 'g') ELSE linha END AS linhas FROM l""")
def horizontal_options_split(spark, d):
    """Options printed on one line, each moved to a line of its own, unless their letters repeat, go back or change case."""
    a = table(spark, d, "alternativas").where(F.col("letra").isin(*"ABCDE") & F.col("texto").isNotNull())
    one = F.concat(F.lit("("), F.col("letra"), F.lit(") "), F.translate("texto", "\n", " "))
    g = a.groupBy("questao_id").agg(F.array_sort(F.collect_list(F.struct("letra", "id", one.alias("t")))).alias("o"))
    return g.select("questao_id", F.array_join(F.transform("o", lambda x: x["t"]), " ").alias("l")).select("questao_id", X.options_on_lines(F.col("l")).alias("linhas"))


_BLANKS = "'Julgue se é verdadeiro ou falso: ( ) ' || coalesce(enunciado, '') || ' (  ) Outra afirmação. Assinale.'"


@query(rf"""WITH t AS (SELECT id, CASE WHEN id % 2 = 0 THEN {_BLANKS} ELSE enunciado END AS t FROM questoes)
SELECT id, CASE WHEN regexp_matches(t, '(?i)verdadeir[oa]') AND regexp_matches(t, '(?i)fals[oa]') AND len(regexp_extract_all(t, '\(\s*\)')) >= 2
 THEN regexp_replace(regexp_replace(regexp_replace(t, '\s*\(\s*\)\s*', chr(10) || chr(10) || '(  )  ', 'g'), '^\s+|\s+$', '', 'g'), '([.!?])\s+((?:Assinale|Marque|Selecione)\b)', '\1' || chr(10) || chr(10) || '\2', 'g') ELSE t END AS exibicao FROM t""")
def display_blanks(spark, d):
    """Items to judge true or false, each apart; every second stem asks for it."""
    asked = F.concat(F.lit("Julgue se é verdadeiro ou falso: ( ) "), F.coalesce("enunciado", F.lit("")), F.lit(" (  ) Outra afirmação. Assinale."))
    t = table(spark, d, "questoes").select("id", F.when(F.col("id") % 2 == 0, asked).otherwise(F.col("enunciado")).alias("t"))
    return t.select("id", X.blanks_on_lines(F.col("t")).alias("exibicao"))


_KIND = (("cex_itens_em_grade", r"(?im)^\s*item\s+(?:\d+\s*){2,}"), ("pares_numero_resposta", r"(?:(?:^|\n)[ \t]*\d{1,3}[ \t]*[-–:.)][ \t]*[A-E](?:[ \t]*|[ \t][^\n]*)(?:\n[^\n]*)*?){3}"), ("matriz_numeros_e_respostas", r"(?im)^[ \t]*(?:(?:quest(?:ão|ao)|item)[ \t]+)?\d{1,3}(?:[ \t]+\d{1,3}){2,}[ \t]*$"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in _KIND) + """ ELSE 'lista_respostas' END AS padrao FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || 'Item 1 2 3' WHEN 1 THEN text || chr(10) || '1 - A' || chr(10) || 'x' || chr(10) || '2) B' || chr(10) || '3: E' WHEN 2 THEN text || chr(10) || '1 2 3 4' ELSE text END AS t FROM documents)""")
def key_classification(spark, d):
    """The kind of answer key that a text looks like; three of five have lines of a key added."""
    more = F.when(F.col("doc_id") % 5 == 0, "\nItem 1 2 3").when(F.col("doc_id") % 5 == 1, "\n1 - A\nx\n2) B\n3: E").when(F.col("doc_id") % 5 == 2, "\n1 2 3 4").otherwise("")
    t = F.concat("text", more)
    return table(spark, d, "documents").select("doc_id", C.first_of(tuple((n, (p,)) for n, p in _KIND), t, "lista_respostas").alias("padrao"))


@query(r"""WITH g AS (SELECT prova_cadastrada_id AS id, ordem // 8 AS l, string_agg(ordem::VARCHAR, ' ' ORDER BY ordem) AS linha FROM prova_cadastrada_questoes GROUP BY 1, 2)
SELECT id, l AS n, linha, len(regexp_extract_all(linha, '\b\d{1,3}\b')) >= 5 AND NOT regexp_matches(linha, '\p{L}{3,}') AS grade FROM g""")
def answer_grid_lines(spark, d):
    """Which lines of numbers look like an answer grid."""
    g = table(spark, d, "prova_cadastrada_questoes").groupBy(F.col("prova_cadastrada_id").alias("id"), F.floor(F.col("ordem") / 8).cast("int").alias("n"))
    g = g.agg(F.array_join(F.array_sort(F.collect_list("ordem")).cast("array<string>"), " ").alias("linha"))
    return g.select("id", "n", "linha", X.is_answer_grid(F.col("linha")).alias("grade"))


_HEADING = _ACC.format(f"regexp_replace({{t}}, '{C.COUNTED}', '')")
_SUBJECT = "(CASE " + " ".join(f"WHEN regexp_matches({_HEADING}, '{C.subject_pattern(k)}') THEN '{v}'" for k, v in C.SUBJECTS) + " END)"


@query(f"SELECT id, {_SUBJECT.format(t='disciplina')} AS assunto FROM questoes WHERE disciplina IS NOT NULL")
def subject_lookup(spark, d):
    """The subject that a typed heading means as a whole."""
    return table(spark, d, "questoes").where("disciplina IS NOT NULL").select("id", C.subject(F.col("disciplina")).alias("assunto"))


_BOARD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(t), '{m}')" for m in marks) + f" THEN '{n}'" for n, marks in C.BOARDS) + " ELSE '' END"


@query(f"WITH x AS (SELECT doc_id, coalesce(titulo,'') || ' ' || text || CASE doc_id % 6 WHEN 0 THEN ' Cebraspe' WHEN 1 THEN ' fgv' ELSE '' END AS t FROM documents) SELECT doc_id, {_BOARD} AS banca FROM x")
def board_inference(spark, d):
    """The board that a text names; every sixth text has one added, as the bank's own boards are invented."""
    extra = F.when(F.col("doc_id") % 6 == 0, " Cebraspe").when(F.col("doc_id") % 6 == 1, " fgv").otherwise("")
    t = F.concat(F.coalesce("titulo", F.lit("")), F.lit(" "), F.col("text"), extra)
    return table(spark, d, "documents").select("doc_id", C.board(t).alias("banca"))


_QUANTITY = "list_max(list_transform(list_concat(" + ", ".join(f"regexp_extract_all(lower(t), '{p}', 1)" for p in C.QUANTITY) + "), lambda x: x::INTEGER))"


@query(f"""WITH c AS (SELECT prova_cadastrada_id AS id, 'Este caderno contém ' || count(*) || ' questões. Não contém 900 questõesinhas nem 1900 questões objetivas. Serão 20 questões objetivas.' AS t FROM prova_cadastrada_questoes GROUP BY 1
UNION ALL SELECT -doc_id, text FROM documents) SELECT id, {_QUANTITY} AS quantidade FROM c""")
def declared_quantity(spark, d):
    """The number of questions that a cover declares, and that each document does; parts of words and longer numbers say nothing."""
    n = table(spark, d, "prova_cadastrada_questoes").groupBy(F.col("prova_cadastrada_id").alias("id")).agg(F.count("*").alias("n"))
    cover = F.format_string("Este caderno contém %d questões. Não contém 900 questõesinhas nem 1900 questões objetivas. Serão 20 questões objetivas.", F.col("n"))
    texts = table(spark, d, "documents").select((-F.col("doc_id")).alias("id"), F.col("text").alias("t"))
    return n.select("id", cover.alias("t")).unionByName(texts).select("id", C.declared_quantity(F.col("t")).alias("quantidade"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS linha FROM documents),
y AS (SELECT doc_id, n, regexp_extract_all(linha, '\b20[0-3]\d\b') AS a FROM l WHERE regexp_matches(linha, '(?i)aplica|edital|concurso|publica|realiza|prova de')),
u AS (SELECT doc_id, n, unnest(a) AS v, generate_subscripts(a, 1) AS k FROM y)
SELECT doc_id, v::INTEGER AS ano FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS r FROM u WHERE v::INTEGER BETWEEN 2000 AND 2035) WHERE r = 1""")
def global_metadata(spark, d):
    """The first year on a line that speaks of the exam."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?iu)aplica|edital|concurso|publica|realiza|prova de"))
    years = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"(\b20[0-3]\d\b)"), F.lit(1))))
    ok = F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(2000, 2035))
    return table(spark, d, "documents").select("doc_id", F.get(ok, F.lit(0)).alias("ano")).where("ano IS NOT NULL")


@query(r"""SELECT id, versao, CASE upper(regexp_replace(trim(versao), '(?i)^(?:prova\s+tipo|prova|tipo|t)\s*', '')) WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4' WHEN 'V' THEN '5' WHEN 'X' THEN '10'
ELSE upper(regexp_replace(trim(versao), '(?i)^(?:prova\s+tipo|prova|tipo|t)\s*', '')) END AS normal FROM documentos_fonte WHERE versao IS NOT NULL""")
def version_labels(spark, d):
    """Version labels of source documents as numbers."""
    return table(spark, d, "documentos_fonte").where("versao IS NOT NULL").select("id", "versao", X.version_label(F.col("versao")).alias("normal"))


_LAYOUT = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(lower(t), '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in C.LAYOUTS) + " ELSE 'pares' END"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i){C.KEY_STATE}preliminar') THEN 'preliminar' WHEN regexp_matches(t, '(?i){C.KEY_STATE}definitivo') THEN 'definitivo' ELSE 'documento_fornecido' END AS situacao,
{_LAYOUT} AS modelo FROM (SELECT doc_id, coalesce(titulo, '') || ' ' || text AS t FROM documents)""")
def key_document_state(spark, d):
    """Whether a text speaks of a preliminary or final key, and which layout it has."""
    t = F.concat(F.coalesce("titulo", F.lit("")), F.lit(" "), F.col("text"))
    return table(spark, d, "documents").select("doc_id", C.key_state(t).alias("situacao"), C.key_layout(t).alias("modelo"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(?:19|20)\d{2}\b'))), ',') AS anos,
array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z]\d{3,}\b'))), ',') AS codigos,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b(?:prova|tipo)\s*\d+\b'), lambda x: regexp_extract(x, '\d+')))), ',') AS versoes FROM documents""")
def identifier_extraction(spark, d):
    """Typed identifiers of each text: years, codes, versions."""

    def found(pattern, group=1):
        return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))), ",")

    return table(spark, d, "documents").select(
        "doc_id", found(r"(\b(?:19|20)\d{2}\b)").alias("anos"), found(r"(\b[A-Z]\d{3,}\b)").alias("codigos"), found(r"(?i)\b(?:prova|tipo)\s*(\d+)\b").alias("versoes")
    )


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({_ACC.format('cargo')}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in C.ROLE_STOP)})))), ' ') AS palavras
FROM questoes WHERE cargo IS NOT NULL""")
def role_tokens(spark, d):
    """The telling words of each role."""
    return table(spark, d, "questoes").where("cargo IS NOT NULL").select("id", F.array_join(X.key_tokens(F.col("cargo"), C.ROLE_STOP), " ").alias("palavras"))


@query(f"SELECT id, regexp_matches(enunciado, '(?i){C.FIGURE}') AS cita_figura FROM questoes")
def figure_references(spark, d):
    """Stems that refer to a figure."""
    return table(spark, d, "questoes").select("id", F.col("enunciado").rlike(f"(?iu){C.FIGURE}").alias("cita_figura"))


@query(r"SELECT id, regexp_replace(enunciado, '[ \t]+((?:I|II|III|IV|V)[ ]?[–-][ ])', chr(10) || '\1', 'g') AS exibicao FROM questoes")
def display_items(spark, d):
    """Roman items each on its own line."""
    return table(spark, d, "questoes").select("id", X.roman_items_on_lines(F.col("enunciado")).alias("exibicao"))


@query("SELECT id, lower(regexp_replace(replace(trim(localizacao), chr(92), '/'), '/+', '/', 'g')) AS caminho FROM documentos_fonte WHERE localizacao IS NOT NULL")
def path_keys(spark, d):
    """Locations as keys: one kind of slash, lower case."""
    p = F.lower(F.regexp_replace(F.translate(F.trim("localizacao"), "\\", "/"), "/+", "/"))
    return table(spark, d, "documentos_fonte").where("localizacao IS NOT NULL").select("id", p.alias("caminho"))


@query(f"""SELECT q.id, l.ref_id, levenshtein({_ACC.format('q.disciplina')}, {_ACC.format('l.nome')})::INTEGER AS distancia FROM questoes q JOIN lista_canonica l ON l.campo = 'disciplina'
AND length({_ACC.format('q.disciplina')}) > 0 AND ascii({_ACC.format('q.disciplina')}) < 128 AND substr({_ACC.format('q.disciplina')}, 1, 1) = substr({_ACC.format('l.nome')}, 1, 1)
AND length(l.nome) BETWEEN length({_ACC.format('q.disciplina')}) - 2 AND length({_ACC.format('q.disciplina')}) + 2 AND levenshtein({_ACC.format('q.disciplina')}, {_ACC.format('l.nome')}) BETWEEN 1 AND 2 AND NOT regexp_matches({_ACC.format('q.disciplina')}, '[^ -~]')""")
def fuzzy_anchor(spark, d):
    """Names of the list within two edits of a typed subject; lengths bound the comparisons."""
    q = table(spark, d, "questoes").select("id", X.accent_key(F.col("disciplina")).alias("a")).where("a <> ''")
    q = q.groupBy("a").agg(F.collect_list("id").alias("ids")).withColumn("n", F.explode(F.sequence(F.length("a") - 2, F.length("a") + 2)))
    c = table(spark, d, "lista_canonica").where("campo = 'disciplina'").select("ref_id", X.accent_key(F.col("nome")).alias("b"))
    j = q.join(c.withColumn("n", F.length("b")), "n")
    j = j.withColumn("distancia", F.levenshtein("a", "b")).where("distancia BETWEEN 1 AND 2")
    return j.select(F.explode("ids").alias("id"), "ref_id", "distancia")


@query("""SELECT id, strftime(iniciada_em, '%d/%m/%Y %H:%M') AS inicio, (epoch_us(finalizada_em) // 1000000 - epoch_us(iniciada_em) // 1000000) AS segundos, CAST(iniciada_em::DATE + 6 AS VARCHAR) AS revisar_em,
round_even(nota, 0) AS nota_inteira, least(greatest(nota, 10), 90) AS nota_limitada FROM tentativas""")
def date_and_number_functions(spark, d):
    """Formatting, differences and sums of dates; half-even rounding and clamping."""
    t = table(spark, d, "tentativas")
    sec = F.unix_seconds(F.col("finalizada_em").cast("timestamp")) - F.unix_seconds(F.col("iniciada_em").cast("timestamp"))
    return t.select(
        "id", F.date_format("iniciada_em", "dd/MM/yyyy HH:mm").alias("inicio"), sec.alias("segundos"), F.date_add("iniciada_em", 6).cast("string").alias("revisar_em"),
        F.bround("nota").alias("nota_inteira"), F.when(F.col("nota").isNotNull(), F.least(F.greatest("nota", F.lit(10.0)), F.lit(90.0))).otherwise(10.0).alias("nota_limitada"),
    )


# ---- lines that repeat over the pages of a document: pages are the texts of one edital


@query("""WITH p AS (SELECT edital, count(*) AS paginas FROM documents WHERE edital IS NOT NULL GROUP BY 1),
l AS (SELECT DISTINCT edital, doc_id, unnest(string_split(text, chr(10))) AS linha FROM documents WHERE edital IS NOT NULL),
c AS (SELECT edital, linha, count(*) AS n FROM l WHERE length(linha) BETWEEN 1 AND 120 AND NOT regexp_matches(linha, '^\\d{1,3}$') AND NOT regexp_matches(linha, '(?i)^(?:preencha|assinale|marque|selecione|indique)\\b') GROUP BY 1, 2)
SELECT c.edital, c.linha, c.n FROM c JOIN p USING (edital) WHERE p.paginas >= 2 AND c.n >= greatest(2, floor(p.paginas * 0.02))""")
def repeated_lines(spark, d):
    """Lines on at least two pages and a share of the pages of a document; numbers and commands aside."""
    docs = table(spark, d, "documents").where("edital IS NOT NULL")
    pages = docs.groupBy("edital").agg(F.count("*").alias("p"))
    lines = docs.select("edital", "doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("linha"))
    ok = F.length("linha").between(1, 120) & ~F.col("linha").rlike(r"^\d{1,3}$") & ~F.col("linha").rlike(r"(?i)^(?:preencha|assinale|marque|selecione|indique)\b")
    n = lines.where(ok).groupBy("edital", "linha").agg(F.count("*").alias("n")).where("n > 1")
    return n.join(pages, "edital").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("p") * 0.02))).select("edital", "linha", "n")


# ---- key documents built from the bank, read back by each reader

_KEYS = """k AS (SELECT p.prova_cadastrada_id AS doc, p.ordem AS numero, upper(trim(q.gabarito)) AS g, q.tipo FROM questoes q JOIN prova_cadastrada_questoes p ON p.questao_id = q.id WHERE upper(trim(q.gabarito)) IN ('A','B','C','D','E','X','CERTO','ERRADO'))"""


def _keys(spark, d):
    g = F.upper(F.trim("gabarito"))
    q = table(spark, d, "questoes").where(g.isin(*"ABCDEX", "CERTO", "ERRADO")).select(F.col("id").alias("questao_id"), g.alias("g"), "tipo")
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id")
    return j.select(F.col("prova_cadastrada_id").alias("doc"), F.col("ordem").alias("numero"), "g", "tipo")


def _printed(keys, per_line, text):
    """Lines (doc, n, linha) of ``per_line`` entries each."""
    g = keys.groupBy("doc", F.floor(F.col("numero") / per_line).cast("int").alias("n"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("numero", "g"))), text), " ").alias("linha"))


def _two_lines(keys, per_line, first, second):
    top = _printed(keys, per_line, lambda x: x["numero"].cast("string"))
    low = _printed(keys, per_line, lambda x: x["g"])
    return top.select("doc", (F.col("n") * 2).alias("n"), F.concat(F.lit(first), "linha").alias("linha")).unionByName(
        low.select("doc", (F.col("n") * 2 + 1).alias("n"), F.concat(F.lit(second), "linha").alias("linha"))
    )


@query(f"WITH {_KEYS} SELECT doc, numero, g AS resposta FROM k WHERE length(g) = 1 AND g <> 'X' UNION ALL SELECT doc, numero, 'Anulada' FROM k WHERE g = 'X'")
def key_pairs_same_line(spark, d):
    """Pairs printed as "1 - A 2 - B" and read back; a void answer is read as such."""
    lines = _printed(_keys(spark, d).where("length(g) = 1"), 5, lambda x: F.concat(x["numero"].cast("string"), F.lit(" - "), x["g"]))
    noise = lines.select("doc", F.lit(999).alias("n"), F.lit("Questões de 1 a 28 – prova A").alias("linha")).distinct()
    return merge_observations(K.same_line_pairs(lines.unionByName(noise)), ["doc", "numero"]).select("doc", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, numero, CASE g WHEN 'C' THEN 'Certo' WHEN 'E' THEN 'Errado' ELSE 'Anulada' END AS resposta FROM k WHERE tipo = 'certo_errado' AND g IN ('C','E','X')")
def key_item_grid(spark, d):
    """True/false grids printed as "Item 1 2" over "C E" and read back."""
    k = _keys(spark, d).where("tipo = 'certo_errado' AND g IN ('C', 'E', 'X')")
    return merge_observations(K.item_grid(_two_lines(k, 10, "Item ", "")), ["doc", "numero"]).select("doc", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, numero, CASE g WHEN 'X' THEN 'Anulada' WHEN 'CERTO' THEN 'Certo' WHEN 'ERRADO' THEN 'Errado' ELSE g END AS resposta FROM k")
def key_two_row_block(spark, d):
    """Rows of numbers over rows of answers, with an answer label, read back."""
    return merge_observations(K.two_rows(_two_lines(_keys(spark, d), 10, "", "Gabarito: ")), ["doc", "numero"]).select("doc", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, numero, CASE g WHEN 'CERTO' THEN 'Certo' ELSE 'Errado' END AS resposta FROM k WHERE g IN ('CERTO','ERRADO')")
def key_spelled_out(spark, d):
    """Answers in words, read back."""
    k = _keys(spark, d).where("g IN ('CERTO', 'ERRADO')")
    lines = _printed(k, 4, lambda x: F.concat(F.lit("QUESTÃO "), x["numero"].cast("string"), F.lit(": "), x["g"]))
    return merge_observations(K.spelled_out(lines), ["doc", "numero"]).select("doc", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, numero, translate(g, 'ABCD', 'BCDA') AS resposta FROM k WHERE g IN ('A','B','C','D')")
def key_multi_version_column(spark, d):
    """Two versions side by side, the heading in the order 2, 1; the column of version 1 is read."""
    k = _keys(spark, d).where("g IN ('A', 'B', 'C', 'D')")
    both = k.select("doc", (F.col("numero") * 1).alias("n"), F.concat_ws(" ", F.col("numero").cast("string"), "g", F.col("numero").cast("string"), F.translate("g", "ABCD", "BCDA")).alias("linha"))
    heads = k.select("doc").distinct().select("doc", F.lit(0).alias("n"), F.lit("PROVA 2 PROVA 1").alias("linha"))
    return merge_observations(K.version_columns(heads.unionByName(both), "1"), ["doc", "numero"]).select("doc", "numero", "resposta")


@query("""SELECT prova_cadastrada_id AS escopo, ordem, last_value(s IGNORE NULLS) OVER (PARTITION BY prova_cadastrada_id ORDER BY ordem, questao_id) AS disciplina FROM
(SELECT l.*, CASE WHEN l.ordem % 4 = 1 THEN q.disciplina END AS s FROM prova_cadastrada_questoes l JOIN questoes q ON q.id = l.questao_id)""")
def subject_forward_fill(spark, d):
    """The last heading before each question of an exam; every fourth question has one."""
    q = table(spark, d, "questoes").select(F.col("id").alias("questao_id"), "disciplina")
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id").withColumn("s", F.when(F.col("ordem") % 4 == 1, F.col("disciplina")))
    w = Window.partitionBy("prova_cadastrada_id").orderBy("ordem", "questao_id")
    return j.select(F.col("prova_cadastrada_id").alias("escopo"), "ordem", F.last("s", ignorenulls=True).over(w).alias("disciplina"))
