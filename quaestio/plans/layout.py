"""Queries over page layout. Words are laid out from the documents' texts: eight a line, forty lines a page.

The words of a line sink by 1.5 each, so lines found by a chain of small steps would differ from anchored ones.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestio.operators import layout as L
from quaestio.plans.registry import Registry
from quaestio.session import table

query = Registry()
_W = r"""w0 AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '\S+')) AS text, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS n FROM documents),
w AS (SELECT doc, (n // 320)::INTEGER AS page, n::INTEGER AS n, text, ((n % 8) * 90 + CASE WHEN doc % 3 = 0 THEN 40 * (n % 8 // 4) ELSE 0 END)::DOUBLE AS x0,
 ((n % 8) * 90 + CASE WHEN doc % 3 = 0 THEN 40 * (n % 8 // 4) ELSE 0 END + CASE WHEN doc % 3 = 0 THEN 60 ELSE 70 + doc % 40 END)::DOUBLE AS x1, ((n % 320 // 8) * 20 + (n % 8) * 1.5)::DOUBLE AS top, ((n % 320 // 8) * 20 + (n % 8) * 1.5 + 10)::DOUBLE AS bottom FROM w0)"""


def _words(spark, d):
    w = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("n", "text"))
    n, third = F.col("n"), F.col("doc") % 3 == 0
    x0 = (n % 8) * 90 + F.when(third, 40 * F.floor((n % 8) / 4)).otherwise(0)
    top = F.floor((n % 320) / 8) * 20 + (n % 8) * 1.5
    return w.select(
        "doc", F.floor(n / 320).cast("int").alias("page"), "n", "text", x0.cast("double").alias("x0"),
        (x0 + F.when(third, 60).otherwise(70 + F.col("doc") % 40)).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"),
    )


@query(f"""WITH {_W} SELECT doc, page, ((n % 320 // 8) * 3 + n % 8 // 3 + 1)::INTEGER AS linha, min(top) AS top, string_agg(text, ' ' ORDER BY x0, n) AS texto FROM w GROUP BY 1, 2, 3""")
def line_grouping(spark, d):
    """Words grouped into lines by an anchored tolerance."""
    return L.anchored_lines(_words(spark, d), 4.0)


@query(f"WITH {_W}, c AS (SELECT doc, page, count(*) AS palavras, count(*) FILTER (x1 <= 400) AS esquerda, count(*) FILTER (x0 >= 400) AS direita, count(*) FILTER (x0 < 400 AND x1 > 400) AS cruzam FROM w GROUP BY 1, 2) SELECT *, esquerda >= 0.45 * palavras AND direita >= 0.45 * palavras AND cruzam <= 0.05 * palavras AS duas_colunas FROM c")
def column_detection(spark, d):
    """Which pages have two columns."""
    return L.column_profile(_words(spark, d), 800.0)


@query(f"""WITH {_W}, c AS (SELECT unnest([1, 2, 3]) AS coluna, unnest([100.0, 350.0, 600.0]) AS centro) SELECT doc, n, coluna FROM (SELECT doc, n, coluna, row_number() OVER (PARTITION BY doc, n ORDER BY abs((x0 + x1) / 2 - centro), coluna) AS k FROM w, c) WHERE k = 1""")
def nearest_column(spark, d):
    """Each word with the nearest of three column centres."""
    w = _words(spark, d)
    three = F.explode(F.array(*[F.struct(F.lit(k).alias("coluna"), F.lit(x).alias("centro")) for k, x in ((1, 100.0), (2, 350.0), (3, 600.0))])).alias("c")
    centres = w.select("doc", "page").distinct().select("doc", "page", three).select("doc", "page", "c.*")
    return L.nearest_column(w, centres).select("doc", "n", "coluna")


@query(f"""WITH {_W}, r AS (SELECT DISTINCT doc, page, 355.0 AS x FROM w WHERE doc % 3 = 0) SELECT doc, page, count(DISTINCT x) + 1 AS colunas FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc = r.doc AND w.page = r.page AND w.x0 < r.x AND w.x1 > r.x) GROUP BY 1, 2""")
def separator_columns(spark, d):
    """Pages that a vertical rule divides into columns."""
    w = _words(spark, d)
    rules = w.where("doc % 3 = 0").select("doc", "page", F.lit(355.0).alias("x")).distinct()
    return L.separator_columns(w, rules)


_M = r"""m AS (SELECT doc_id AS doc, (generate_subscripts(x, 1) - 1)::INTEGER AS n, unnest(x)::INTEGER AS numero FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?m)^(\d{1,3})[.)]', 1), lambda v: v) AS x FROM documents)
UNION ALL SELECT prova_cadastrada_id + 1000000, (row_number() OVER (PARTITION BY prova_cadastrada_id ORDER BY ordem, questao_id) - 1)::INTEGER, numero_oficial FROM prova_cadastrada_questoes JOIN questoes ON id = questao_id WHERE numero_oficial IS NOT NULL)"""


def _marks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^(\d{1,3})[.)]"), F.lit(1))).alias("n", "x"))
    q = table(spark, d, "questoes").where("numero_oficial IS NOT NULL").select(F.col("id").alias("questao_id"), "numero_oficial")
    j = table(spark, d, "prova_cadastrada_questoes").join(q, "questao_id")
    w = Window.partitionBy("prova_cadastrada_id").orderBy("ordem", "questao_id")
    e = j.select((F.col("prova_cadastrada_id") + 1000000).alias("doc"), (F.row_number().over(w) - 1).alias("n"), F.col("numero_oficial").alias("numero"))
    return t.select("doc", "n", F.col("x").cast("int").alias("numero")).unionByName(e)


@query(f"WITH {_M}, f AS (SELECT doc, numero, min(n) AS n FROM m WHERE numero >= 1 GROUP BY 1, 2) SELECT doc, numero, n FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY numero) AS k FROM f) WHERE k = numero")
def first_contiguous_numbers(spark, d):
    """First occurrences of numbers, from 1 as far as none is missing."""
    return L.first_contiguous(_marks(spark, d), "doc")


@query()
def marker_chain(spark, d):
    """The longest chain of consecutive numbers of each document."""
    return L.marker_chain(_marks(spark, d).withColumn("boa", (F.col("numero") % 2).cast("int")), "doc")


@query(f"WITH {_W} SELECT doc, page, n, lead(n) OVER (PARTITION BY doc, page, CASE WHEN x0 >= 360 THEN 2 ELSE 1 END ORDER BY top, n)::INTEGER AS seguinte FROM w WHERE regexp_matches(text, '^[0-9]+[.)]?$')")
def following_marker(spark, d):
    """The next number-like word in the same column of a page."""
    m = _words(spark, d).where(F.col("text").rlike(r"^[0-9]+[.)]?$")).withColumn("c", F.when(F.col("x0") >= 360, 2).otherwise(1))
    return m.select("doc", "page", "n", F.lead("n").over(Window.partitionBy("doc", "page", "c").orderBy("top", "n")).alias("seguinte"))


@query(f"WITH {_W} SELECT doc, n, row_number() OVER (PARTITION BY doc, page, n % 320 // 8, lower(text) ORDER BY x0, n)::INTEGER AS vez FROM w")
def nth_occurrence(spark, d):
    """Which occurrence of its text in its line each word is."""
    w = _words(spark, d).withColumn("l", F.floor((F.col("n") % 320) / 8)).withColumn("t", F.lower("text"))
    return w.select("doc", "n", F.row_number().over(Window.partitionBy("doc", "page", "l", "t").orderBy("x0", "n")).alias("vez"))


@query(f"WITH {_W}, l AS (SELECT doc, page, n % 320 // 8 AS l, min(x0) + doc % 7 AS m FROM w GROUP BY 1, 2, 3) SELECT doc, median(m) AS mediana, list_sort(list(m))[len(list(m)) // 2 + 1] AS superior FROM l GROUP BY 1")
def margin_medians(spark, d):
    """The median left margin of a document's lines, and the upper middle one."""
    w = _words(spark, d)
    m = w.groupBy("doc", "page", F.floor((F.col("n") % 320) / 8).alias("l")).agg((F.min("x0") + F.col("doc") % 7).alias("m"))
    g = m.groupBy("doc").agg(F.median("m").alias("mediana"), F.array_sort(F.collect_list("m")).alias("a"))
    return g.select("doc", "mediana", F.element_at("a", (F.floor(F.size("a") / 2) + 1).cast("int")).alias("superior"))


_PG = "p AS (SELECT doc_id AS doc, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS page, unnest(string_split(text, chr(10))) AS t FROM documents), q AS (SELECT doc, page, t, CASE WHEN regexp_matches(t, '^\\([A-E]\\) ') THEN 'multipla_escolha' WHEN regexp_matches(t, '^\\d+\\. ') THEN 'pontuada' ELSE 'texto' END AS perfil, regexp_matches(t, '^\\([A-E]\\) |^\\d+\\. ') AS forte FROM p)"


def _pages(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "t"))
    kind = F.when(F.col("t").rlike(r"^\([A-E]\) "), "multipla_escolha").when(F.col("t").rlike(r"^\d+\. "), "pontuada").otherwise("texto")
    return p.withColumn("perfil", kind).withColumn("forte", F.col("t").rlike(r"^\([A-E]\) |^\d+\. "))


@query(f"""WITH {_PG}, s AS (SELECT *, coalesce(last_value(CASE WHEN forte THEN perfil END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page), first_value(CASE WHEN forte THEN perfil END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), perfil) AS pf FROM q),
g AS (SELECT *, sum(CASE WHEN pf IS DISTINCT FROM a THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS grupo FROM (SELECT *, lag(pf) OVER (PARTITION BY doc ORDER BY page) AS a FROM s))
SELECT doc, grupo::BIGINT AS grupo, min(pf) AS perfil, min(page) AS de, max(page) AS ate FROM g GROUP BY 1, 2""")
def page_routing_islands(spark, d):
    """Runs of pages of one reading profile; a page is a line here, weak ones follow the strong one before."""
    return L.page_groups(_pages(spark, d).select("doc", "page", "perfil", "forte"))


@query(f"WITH {_PG}, k AS (SELECT doc, string_agg(sha256(t), '|' ORDER BY page) AS k FROM q GROUP BY 1), f AS (SELECT k, min(doc) AS a FROM k GROUP BY 1) SELECT a, doc AS b FROM k JOIN f USING (k) WHERE doc <> a")
def document_equality(spark, d):
    """Documents equal page by page, each with the first of its kind."""
    return L.equal_documents(_pages(spark, d).select("doc", "page", F.sha2("t", 256).alias("sha")))


@query("""WITH p AS (SELECT edital AS doc, doc_id AS page, string_split(text, chr(10)) AS ls FROM documents WHERE edital IS NOT NULL), l AS (SELECT doc, page, ls[1] AS texto FROM p UNION ALL SELECT doc, page, ls[len(ls)] FROM p WHERE len(ls) > 1),
c AS (SELECT doc, texto, count(DISTINCT page) AS n FROM l GROUP BY 1, 2), t AS (SELECT doc, count(DISTINCT page) AS p FROM l GROUP BY 1) SELECT doc, texto, n FROM c JOIN t USING (doc) WHERE n >= greatest(3, floor(0.01 * p))""")
def edge_band_lines(spark, d):
    """Lines at the edges of several pages of one document; a document is an edital, its pages the texts."""
    p = table(spark, d, "documents").where("edital IS NOT NULL").select(F.col("edital").alias("doc"), F.col("doc_id").alias("page"), F.split("text", "\n").alias("ls"))
    n = F.size("ls")
    at = F.explode(F.when(n > 1, F.array(F.struct(F.lit(0.0).alias("top"), F.col("ls")[0].alias("texto")), F.struct(F.lit(100.0).alias("top"), F.element_at("ls", -1).alias("texto")))).otherwise(F.array(F.struct(F.lit(0.0).alias("top"), F.col("ls")[0].alias("texto"))))).alias("l")
    return L.edge_lines(p.select("doc", "page", at).select("doc", "page", "l.*"), 100.0, 0.01)


@query("""SELECT event_id, NOT isnan(value) AND value IS NOT NULL AND value / 1000 BETWEEN 0 AND 1 AND value >= 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND value > 0 AS valida FROM events""")
def detection_validity(spark, d):
    """Which boxes of a reader are usable; an event's value stands for one, with no width in every third and no height in every fifth."""
    v, i = F.col("value"), F.col("event_id")
    side = lambda k: F.when(i % k == 0, v).otherwise(v * 2)
    boxes = table(spark, d, "events").select("event_id", v.alias("x0"), side(3).alias("x1"), v.alias("top"), side(5).alias("bottom"), (v / 1000).alias("confianca"))
    return boxes.select("event_id", L.valid_detections().alias("valida"))


@query(f"""WITH {_W} SELECT doc, page, n, dense_rank() OVER (PARTITION BY doc, page ORDER BY n % 320 // 8, n % 8 // 4)::INTEGER AS linha FROM w WHERE (n % 320 // 8) % 5 <> 0""")
def clustered_rows(spark, d):
    """Boxes of enough confidence in rows by their centres, which sink along a row; every fifth line is read with little confidence."""
    w = _words(spark, d).withColumn("confianca", F.when(F.floor((F.col("n") % 320) / 8) % 5 == 0, 0.5).otherwise(0.9))
    return L.clustered_rows(w.select("doc", "page", "n", "top", "bottom", "confianca")).select("doc", "page", "n", "linha")


@query(f"WITH {_W} SELECT doc, page, n FROM w WHERE n % 8 IN (0, 3, 6)")
def suppressed_marks(spark, d):
    """Marks that aren't within 3 of one kept before on their page."""
    return L.suppress_near(_words(spark, d).select("doc", "page", "n", "top"), ["doc", "page"], "top", 3.0).select("doc", "page", "n")
