"""Cutting documents into question blocks and blocks into stems and options.

A separator sign is put before each marker and the text is split at it, all in built-in functions. A
document is one row, so nothing is shuffled to cut it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEP = "\x1e"
#: Markers of questions by profile; the first group is the number.
PROFILES = {
    "questoes_nomeadas": r"(?m)^[ \t]*(?:QUESTÃO|QUESTAO|Questão|ITEM) *0*(\d{1,3})(?:[ \t]*[.):–-]|[ \t]+|$)",
    "pontuada": r"(?m)^[ \t]*(\d{1,3})[.)][ \t]+",
    "traco": r"(?m)^[ \t]*(\d{1,3})[ \t]+[–—-][ \t]+",
    "numero_isolado": r"(?m)^[ \t]*(\d{1,3})[ \t]*$",
    "dois_pontos": r"(?m)^[ \t]*(\d{1,3})[ \t]*:[ \t]+",
    "numero_espaco": r"(?m)^[ \t]*(\d{1,3})[ \t]+(?=[^\s–—-])",
}
OPTION = r"(?m)^[ \t]*\(?([A-E])\)[ \t]+"
LETTERS = ["A", "B", "C", "D", "E"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _after(array: Column, start: Column) -> Column:
    """The elements from position ``start`` on."""
    return F.slice(array, start, F.greatest(F.lit(0), F.size(array) - start + 1))


def blocks(df: DataFrame, keys: list[str], text: str, profile: str) -> DataFrame:
    """(keys, k, numero, corpo): the blocks after each marker of a profile, in order."""
    marked = F.regexp_replace(text, PROFILES[profile], SEP + "$1" + "\x1f")
    parts = _after(F.split(F.col("_m"), SEP), F.lit(2))
    out = df.withColumn("_m", marked).select(*keys, F.posexplode(parts).alias("k", "_b"))
    number = F.substring_index("_b", "\x1f", 1)
    return out.select(*keys, "k", number.cast("int").alias("numero"), strip(F.substring(F.col("_b"), F.length(number) + 2, F.length("_b"))).alias("corpo"))


def parts(body: Column) -> Column:
    """Struct (enunciado, opcoes) of a block; a list A to E inside the stem stays there if another starts at A after it."""
    cut = F.split(F.regexp_replace(body, OPTION, SEP + "$1"), SEP)
    options = F.transform(_after(cut, F.lit(2)), lambda x: F.struct(F.left(x, F.lit(1)).alias("letra"), strip(F.substring(x, F.lit(2), F.length(x))).alias("texto")))
    starts = F.filter(F.transform(options, lambda o, i: F.when(o["letra"] == "A", i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(starts), F.lit(0))
    inner = F.transform(F.slice(options, F.lit(1), last), lambda o: F.concat(F.lit("\n("), o["letra"], F.lit(") "), o["texto"]))
    stem = strip(F.concat(strip(cut[0]), F.array_join(inner, "")))
    return F.struct(stem.alias("enunciado"), _after(options, last + 1).alias("opcoes"))


def parsed(df: DataFrame) -> DataFrame:
    """Blocks with enunciado, opcoes, tipo and confianca; stems under ten signs are dropped."""
    p = df.withColumn("_p", parts(F.col("corpo"))).select(*df.columns, "_p.*").where(F.length("enunciado") >= 10)
    n = F.size("opcoes")
    sure = (
        F.when(n >= 4, "alta").when(n >= 1, "media").when(F.length("enunciado") >= 80, "alta").when(F.length("enunciado") >= 30, "media").otherwise("baixa")
    )
    return p.withColumn("tipo", F.when(n > 0, "multipla_escolha").otherwise("certo_errado")).withColumn("confianca", sure)


def score(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pontos): for blocks of one document and profile, compared field by field from the first.

    Fields: distinct numbers, fewer repeats, fewer defects, valid blocks, narrower range of numbers.
    """
    p = df.withColumn("_p", parts(F.col("corpo")))
    n, letters = F.size("_p.opcoes"), F.transform("_p.opcoes", lambda o: o["letra"])
    short, lone = F.length("_p.enunciado") < 10, n == 1
    valid = ~short & ~lone & (n > 1)
    ordered = letters == F.slice(F.array(*map(F.lit, LETTERS)), F.lit(1), n)
    agg = p.groupBy(*keys).agg(
        F.countDistinct(F.when(valid, F.col("numero"))).alias("distintos"),
        F.count_if(valid).alias("validos"),
        F.count_if(short | lone | (valid & ~ordered)).alias("defeitos"),
        (F.max(F.when(valid, F.col("numero"))) - F.min(F.when(valid, F.col("numero")))).alias("amplitude"),
    )
    points = F.struct(
        "distintos", (F.col("distintos") - F.col("validos")).alias("repetidos"), (-F.col("defeitos")).alias("defeitos"), "validos",
        (-F.coalesce("amplitude", F.lit(0))).cast("long").alias("amplitude"),
    )
    return agg.select(*keys, points.alias("pontos"))


def compete(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, perfil, pontos, empate): the profile of the best score; a tie of two is told, the first in the list wins."""
    out = None
    for rank, name in enumerate(PROFILES):
        s = score(blocks(df, [key], text, name), [key]).where("pontos.validos >= 2")
        s = s.select(key, F.lit(name).alias("perfil"), "pontos", F.lit(-rank).alias("ordem"))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(key)
    ranked = out.withColumn("k", F.row_number().over(w.orderBy(F.desc("pontos"), F.desc("ordem")))).withColumn("melhor", F.max("pontos").over(w))
    ranked = ranked.withColumn("empate", F.count_if(F.col("pontos") == F.col("melhor")).over(w) > 1)
    return ranked.where("k = 1").select(key, "perfil", "pontos", "empate")


def next_k_support(df: DataFrame, group: str, order: list[str], declared: str, count: str, text: str) -> DataFrame:
    """Rows with ``apoio``: a row may declare a text for itself and the next rows, ``count`` in all.

    It holds for exactly that many rows before the next declaration; where fewer follow, for none.
    """
    w = Window.partitionBy(group).orderBy(*order)
    part = df.withColumn("_d", F.sum(F.col(declared).cast("int")).over(w))
    inside = Window.partitionBy(group, "_d")
    first = part.withColumn("_i", F.row_number().over(inside.orderBy(*order)))
    # the declaring row is the first of its part
    want = F.first_value(F.when(F.col(declared), F.col(count)), True).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    said = F.first_value(F.when(F.col(declared), F.col(text)), True).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ok = (F.col("_d") > 0) & (F.col("_i") <= want) & (F.count("*").over(inside) >= want)
    return first.withColumn("apoio", F.when(ok, said)).drop("_d", "_i")


def smallest_window(regions: DataFrame, needles: DataFrame, key: str) -> DataFrame:
    """(key, de, ate): the shortest run of regions, in order, whose joined text contains the needle; ties by start.

    regions: key, n, texto (already in comparing form); needles: key, agulha. Each place of the needle in
    the whole text, taken left to right without overlap, is covered by one run of regions, found by
    their offsets; so the work grows with the text, not with the number of possible runs.
    """
    w = Window.partitionBy(key).orderBy("n")
    size = F.length("texto") + 1
    lines = regions.select(
        key, F.row_number().over(w).alias("i"), (F.sum(size).over(w) - size).alias("a"), F.sum(size).over(w).alias("b")
    )
    whole = regions.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "texto"))), lambda r: r["texto"]), " ").alias("t"))
    hit = whole.join(needles.where("agulha <> ''"), key).where(F.contains("t", F.col("agulha")))
    before = F.split("t", F.concat(F.lit(r"\Q"), F.col("agulha"), F.lit(r"\E")))
    places = hit.select(key, F.length("agulha").alias("m"), F.posexplode(F.slice(before, F.lit(1), F.size(before) - 1)).alias("o", "p"))
    at = F.sum(F.length("p")).over(Window.partitionBy(key).orderBy("o")) + F.col("o") * F.col("m")
    places = places.select(key, "o", at.alias("s"), (at + F.col("m") - 1).alias("e"))
    inside = lambda x: (F.col("a") <= F.col(x)) & (F.col(x) < F.col("b"))
    first = places.join(lines, key).where(inside("s")).select(key, "o", F.col("i").alias("de"))
    last = places.join(lines, key).where(inside("e")).select(key, "o", F.col("i").alias("ate"))
    best = first.join(last, [key, "o"]).groupBy(key).agg(F.min(F.struct((F.col("ate") - F.col("de")).alias("d"), "de", "ate")).alias("b"))
    return best.select(key, "b.de", "b.ate")
