"""Page layout over a table of words: (doc, page, n, text, x0, x1, top, bottom).

Files are read elsewhere; here a page is a set of rows. What depends on the order of the words of one
page is folded over that page's words, which a page bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]


def anchored_lines(words: DataFrame, tolerance: float) -> DataFrame:
    """(doc, page, linha, top, texto): words sorted by (top, x0) into lines.

    A word starts a line where its top is more than ``tolerance`` from the first word of the present
    line; the anchor stays, so slowly sinking words don't chain into one line.
    """
    w = F.array_sort(F.collect_list(F.struct("top", "x0", "n", "text")))
    page = words.groupBy(*PAGE).agg(w.alias("w"))
    page = page.select(*PAGE, "w", _anchors(F.array_distinct(F.transform("w", lambda x: x["top"])), lambda t: F.lit(tolerance)).alias("_as"))
    each = page.select(*PAGE, "_as", F.explode("w").alias("r"))
    each = each.select(*PAGE, F.size(F.filter("_as", lambda a: a <= F.col("r.top"))).alias("linha"), "r")
    return each.groupBy(*PAGE, "linha").agg(
        F.min("r.top").alias("top"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.x0", "r.n", "r.text"))), lambda x: x["text"]), " ").alias("texto")
    )


def _anchors(sorted_at: Column, tolerance) -> Column:
    """Of sorted places those that start a line: more than the tolerance behind the start of the line before. Only starts are stored."""
    zero = F.array().cast("array<double>")
    return F.aggregate(
        sorted_at, zero, lambda s, x: F.when((F.size(s) == 0) | (x.cast("double") - F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) > tolerance(x)), F.concat(s, F.array(x.cast("double")))).otherwise(s)
    )


def clustered_rows(boxes: DataFrame, least_confidence: float = 0.65, least: float = 4.0) -> DataFrame:
    """``boxes`` of enough confidence with ``linha``: sorted by centre, a row ends where the centre leaves
    the first centre of the row by more than max(``least``, half the height).

    The boxes themselves go through the fold, as in ``suppress_near``.
    """
    ok = boxes.where(F.col("confianca") >= least_confidence)
    zero = F.struct(F.lit(None).alias("anchor"), F.lit(0).alias("at"), F.array().alias("starts")).cast("struct<anchor:double,at:int,starts:array<int>>")

    def step(s: Column, x: Column) -> Column:
        new = s["anchor"].isNull() | (F.abs(x["c"] - s["anchor"]) > F.greatest(F.lit(least), x["h"] / 2))
        starts = F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        return F.struct(F.when(new, x["c"]).otherwise(s["anchor"]).alias("anchor"), (s["at"] + 1).alias("at"), starts.alias("starts"))

    def row(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_w"))
        return F.transform(F.slice("_w", start + 1, end - start), lambda x: F.struct(F.get("_rows", x["i"]).alias("r"), (k + 1).alias("linha")))

    place = lambda x: (((x["top"] + x["bottom"]) / 2).cast("double").alias("c"), x["n"], (x["bottom"] - x["top"]).alias("h"))
    g = _pages_sorted(ok, PAGE, place)
    g = g.select(*PAGE, "_rows", "_w", F.aggregate("_w", zero, step)["starts"].alias("_starts"))
    each = g.select(*PAGE, F.explode(F.flatten(F.transform("_starts", row))).alias("_e"))
    return each.select(*[F.col(c) if c in PAGE else F.col("_e")["r"][c].alias(c) for c in ok.columns], F.col("_e.linha").alias("linha"))


def suppress_near(marks: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """``marks`` without those within ``tolerance`` of one kept before, in the order of ``at``.

    In that order the last one kept is the nearest. The marks themselves go through the fold; a join with
    them could be planned as a broadcast of all.
    """
    g = _pages_sorted(marks, keys, lambda x: (x[at].cast("double").alias("a"), x["n"]))
    none = F.filter("_w", lambda x: F.lit(False))
    keep = F.aggregate("_w", none, lambda s, x: F.when(F.abs(F.try_element_at(s, F.lit(-1))["a"] - x["a"]) <= tolerance, s).otherwise(F.concat(s, F.array(x))))
    each = g.select(*keys, F.explode(F.transform(keep, lambda x: F.get("_rows", x["i"]))).alias("_r"))
    return each.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in marks.columns])


def _pages_sorted(df: DataFrame, keys: list[str], place) -> DataFrame:
    """(*keys, _rows, _w) of each group: its rows without the keys, and in order their places with i, where each stands in ``_rows``; rows needn't be orderable."""
    g = df.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c) for c in df.columns if c not in keys])).alias("_rows"))
    return g.select(*keys, "_rows", F.sort_array(F.transform("_rows", lambda x, i: F.struct(*place(x), i.alias("i")))).alias("_w"))


def marker_chain(marks: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, n, numero): the longest chain of markers with consecutive numbers in document order.

    Of chains of one length the one of better local quality wins, then the earliest. ``marks`` has key,
    n (order), numero, boa (local quality 0 or 1). The state is the best chain for each last number.
    """
    chain = "array<struct<n:int,numero:int>>"
    kind = f"map<int,struct<q:int,c:{chain}>>"
    g = marks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "numero", "boa"))).alias("m"))

    def step(s: Column, x: Column) -> Column:
        before = F.element_at(s, x["numero"] - 1)
        c = F.concat(F.coalesce(before["c"], F.array().cast(chain)), F.array(F.struct(x["n"], x["numero"]).cast("struct<n:int,numero:int>")))
        q = F.coalesce(before["q"], F.lit(0)) + x["boa"]
        have = F.element_at(s, x["numero"])
        better = have.isNull() | (F.size(c) > F.size(have["c"])) | ((F.size(c) == F.size(have["c"])) & (q > have["q"]))
        rest = F.map_filter(s, lambda k, v: k != x["numero"])
        return F.when(better, F.map_concat(rest, F.create_map(x["numero"], F.struct(q.alias("q"), c.alias("c"))))).otherwise(s).cast(kind)

    best = F.aggregate("m", F.create_map().cast(kind), step)
    ends = F.transform(F.map_values(best), lambda v: F.struct(F.size(v["c"]).alias("l"), v["q"].alias("q"), (-v["c"][0]["n"]).alias("e"), v["c"].alias("c")))
    top = g.select(key, F.array_max(ends).alias("t")).where(F.col("t.l") >= least)
    return top.select(key, F.explode("t.c").alias("c")).select(key, "c.n", "c.numero")


def first_contiguous(marks: DataFrame, key: str, start: int = 1) -> DataFrame:
    """(key, numero, n): the first occurrence of each number, as far as numbers follow on without a gap."""
    first = marks.groupBy(key, "numero").agg(F.min("n").alias("n")).where(F.col("numero") >= start)
    w = Window.partitionBy(key).orderBy("numero")
    return first.withColumn("_k", F.row_number().over(w) + start - 1).where("numero = _k").drop("_k")


def column_profile(words: DataFrame, width: float, confined: float = 0.45) -> DataFrame:
    """(doc, page, palavras, esquerda, direita, cruzam, duas_colunas) of each page by where its words lie."""
    mid = width / 2
    agg = words.groupBy(*PAGE).agg(
        F.count("*").alias("palavras"), F.count_if(F.col("x1") <= mid).alias("esquerda"), F.count_if(F.col("x0") >= mid).alias("direita"),
        F.count_if((F.col("x0") < mid) & (F.col("x1") > mid)).alias("cruzam"),
    )
    two = (F.col("esquerda") >= confined * F.col("palavras")) & (F.col("direita") >= confined * F.col("palavras")) & (F.col("cruzam") <= 0.05 * F.col("palavras"))
    return agg.withColumn("duas_colunas", two)


def separator_columns(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, page, colunas) of pages with one or two long vertical rules that no word crosses."""
    crossing = words.join(rules, PAGE).where((F.col("x0") < F.col("x")) & (F.col("x1") > F.col("x"))).select(*PAGE).distinct()
    return rules.groupBy(*PAGE).agg((F.countDistinct("x") + 1).alias("colunas")).where("colunas <= 3").join(crossing, PAGE, "left_anti")


def nearest_column(words: DataFrame, centres: DataFrame) -> DataFrame:
    """``words`` with the column of the nearest centre on their page; ties to the left."""
    per = centres.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("coluna", "centro"))).alias("_cs"))
    mid = (F.col("x0") + F.col("x1")) / 2
    best = F.array_min(F.transform("_cs", lambda c: F.struct(F.abs(mid - c["centro"]).alias("d"), c["coluna"].alias("coluna"))))
    return words.join(per, PAGE).withColumn("coluna", best["coluna"]).drop("_cs")


def edge_lines(lines: DataFrame, height: float, share: float = 0.6) -> DataFrame:
    """(doc, texto, n): lines in the top 7.5 % or bottom 10 % of at least max(3, share) of a document's pages."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("p"))
    edge = lines.where((F.col("top") <= 0.075 * height) | (F.col("top") >= 0.9 * height))
    n = edge.groupBy("doc", "texto").agg(F.countDistinct("page").alias("n"))
    return n.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(3), F.floor(share * F.col("p")))).select("doc", "texto", "n")


def page_groups(pages: DataFrame) -> DataFrame:
    """(doc, grupo, perfil, de, ate): runs of pages of one profile; a page without a strong mark follows the one before."""
    w = Window.partitionBy("doc").orderBy("page")
    strong = F.last(F.when(F.col("forte"), F.col("perfil")), ignorenulls=True).over(w)
    first = F.first_value(F.when(F.col("forte"), F.col("perfil")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = pages.withColumn("_p", F.coalesce(strong, first, F.col("perfil")))
    p = p.withColumn("_n", (F.coalesce(F.lag("_p").over(w) != F.col("_p"), F.lit(True))).cast("int")).withColumn("grupo", F.sum("_n").over(w))
    return p.groupBy("doc", "grupo").agg(F.first("_p").alias("perfil"), F.min("page").alias("de"), F.max("page").alias("ate"))


def equal_documents(pages: DataFrame) -> DataFrame:
    """(a, b): documents with the same number of pages and the same digest on each, by one digest a document."""
    d = pages.groupBy("doc").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "sha"))), lambda x: x["sha"]), "|"), 256).alias("k"))
    first = d.groupBy("k").agg(F.min("doc").alias("a"))
    return d.join(first, "k").where("doc <> a").select("a", F.col("doc").alias("b"))


def valid_detections() -> Column:
    """Whether a detection has a confidence in [0, 1] and a finite box with positive sides."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x0, x1, top, bottom, conf = (F.col(c) for c in ("x0", "x1", "top", "bottom", "confianca"))
    return F.coalesce(fine(conf) & conf.between(0, 1) & fine(x0) & fine(x1) & fine(top) & fine(bottom) & (x0 >= 0) & (top >= 0) & (x1 > x0) & (bottom > top), F.lit(False))
