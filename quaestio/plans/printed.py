"""Queries over printed forms: markers, option signs, key tables and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaestio.operators import keytext as K
from quaestio.operators import printed as P
from quaestio.operators.linkage import merge_observations
from quaestio.plans.registry import Registry
from quaestio.plans.texts import _KEYS, _SUBJECT, _keys, _printed, _two_lines
from quaestio.session import table

query = Registry()


@query(r"""SELECT questao_id, string_agg(letra || ') ' || regexp_replace(texto, '\s+', ' ', 'g'), chr(10) ORDER BY letra, id) AS texto FROM alternativas WHERE letra IN ('A','B','C','D','E') AND texto IS NOT NULL AND NOT regexp_matches(trim(regexp_replace(texto, '\s+', ' ', 'g')), '^$')
GROUP BY 1 HAVING count(*) FILTER (letra = 'A') > 0 AND count(*) FILTER (letra = 'B') > 0 AND min(letra) = 'A'""")
def format_canonical(spark, d):
    """Options printed with circled letters, in one form again."""
    t = F.regexp_replace("texto", r"\s+", " ")
    a = table(spark, d, "alternativas").where(F.col("letra").isin(*"ABCDE") & (F.trim(t) != ""))
    one = F.concat(F.translate("letra", "ABCDE", "ⒶⒷⒸⒹⒺ"), F.lit(" "), t)
    g = a.groupBy("questao_id").agg(F.array_sort(F.collect_list(F.struct("letra", "id", one.alias("t")))).alias("o"), F.collect_set("letra").alias("l"))
    g = g.where(F.array_contains("l", "A") & F.array_contains("l", "B"))
    return g.select("questao_id", P.canonical_format(F.array_join(F.transform("o", lambda x: x["t"]), "\n")).alias("texto"))




def _broken(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '\\1' || chr(10) || '\\2', 'g')"


_NAMED = _broken(_broken("enunciado || ' QUESTÃO 9. Outra pergunta'", P.INLINE_NAMED), P.INLINE_NAMED)


@query(f"SELECT id, {_broken(_NAMED, '(?m)' + P.INLINE_PLAIN)} AS texto FROM questoes")
def inline_marker_break(spark, d):
    """Question markers run into the line before them get their own line: those in stems as stored, and one behind each."""
    t = F.concat("enunciado", F.lit(" QUESTÃO 9. Outra pergunta"))
    return table(spark, d, "questoes").select("id", P.break_inline_markers(t).alias("texto"))


@query(rf"""WITH l AS (SELECT id, string_split('Leia as instruções' || chr(10) || '01 - não vire' || chr(10) || 'Atualidades' || chr(10) || '1. ' || enunciado, chr(10)) AS ls FROM questoes),
m AS (SELECT id, ls, list_max(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '{P.MARKER_LINE}') THEN i END)) AS ultimo FROM l),
s AS (SELECT id, ls, list_min(list_transform(ls, lambda x, i: CASE WHEN i < ultimo AND {_SUBJECT.format(t='x')} IS NOT NULL THEN i END)) AS inicio FROM m)
SELECT id, array_to_string(CASE WHEN inicio IS NULL THEN ls ELSE ls[inicio:] END, chr(10)) AS texto FROM s""")
def front_matter_removed(spark, d):
    """A booklet without its cover; its body is a stem as stored."""
    t = F.concat(F.lit("Leia as instruções\n01 - não vire\nAtualidades\n1. "), "enunciado")
    return table(spark, d, "questoes").select("id", P.without_front_matter(t).alias("texto"))


@query(f"WITH {_KEYS} SELECT doc, numero, CASE g WHEN 'X' THEN 'Anulada' ELSE g END AS resposta FROM k WHERE length(g) = 1 AND numero BETWEEN 1 AND 200")
def key_table_cells(spark, d):
    """Answers from table rows of number and letter cells; years and codes are no numbers."""
    k = _keys(spark, d).where("length(g) = 1")
    rows = k.select("doc", F.array(F.format_string("%02d", "numero"), F.col("g"), F.lit("2026"), F.lit("A")).alias("celulas"))
    return merge_observations(P.cell_pairs(rows), ["doc", "numero"]).select("doc", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, CASE WHEN numero % 2 = 0 THEN 'Analista' ELSE 'Técnico' END AS cargo, numero, g AS resposta FROM k WHERE g IN ('A','B','C','D','E')")
def key_role_blocks(spark, d):
    """Keys of two roles in one document, told apart by their headers."""
    k = _keys(spark, d).where("g IN ('A', 'B', 'C', 'D', 'E')")
    parts = []
    for rest, role in ((0, "Analista"), (1, "Técnico")):
        lines = _printed(k.where(F.col("numero") % 2 == rest), 6, lambda x: F.concat(x["numero"].cast("string"), F.lit(". "), x["g"]))
        head = lines.select("doc", F.lit(1000 * rest).alias("n"), F.lit(f"CARGO: {role}").alias("linha")).distinct()
        parts.append(head.unionByName(lines.select("doc", (F.col("n") + 1000 * rest + 1).alias("n"), "linha")))
    told = P.role_blocks(parts[0].unionByName(parts[1]))
    read = K.same_line_pairs(told.select(F.struct("doc", "cargo").alias("doc"), "n", "linha"))
    return merge_observations(read, ["doc", "numero"]).select("doc.doc", "doc.cargo", "numero", "resposta")


@query(f"WITH {_KEYS} SELECT doc, numero, CASE g WHEN 'X' THEN 'Anulada' WHEN 'CERTO' THEN 'Certo' WHEN 'ERRADO' THEN 'Errado' ELSE g END AS resposta FROM k")
def key_composed(spark, d):
    """A key document in three styles at once, read by all readers and merged."""
    k = _keys(spark, d)
    pairs = _printed(k.where("g IN ('A', 'B', 'C')"), 5, lambda x: F.concat(x["numero"].cast("string"), F.lit(" "), x["g"]))
    words = _printed(k.where("length(g) > 1"), 4, lambda x: F.concat(x["numero"].cast("string"), F.lit(" "), x["g"])).withColumn("n", F.col("n") + 5000)
    rows = _two_lines(k.where("g IN ('D', 'E', 'X')"), 10, "Item ", "Gabarito ").withColumn("n", F.col("n") + 9000)
    lines = pairs.unionByName(words).unionByName(rows)
    read = K.same_line_pairs(lines).unionByName(K.spelled_out(lines)).unionByName(K.two_rows(lines))
    return merge_observations(read, ["doc", "numero"]).select("doc", "numero", "resposta")


@query()
def highlighted_difference(spark, d):
    """Stems against their squeezed lower-case form, with the changes marked in HTML."""
    q = table(spark, d, "questoes").where("enunciado IS NOT NULL")
    udf = F.pandas_udf(P.marked_difference, "string")
    return q.select("id", udf("enunciado", F.lower(F.regexp_replace("enunciado", r"\s+", " "))).alias("marcado"))
