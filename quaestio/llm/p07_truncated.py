"""Problem 7: values that lost their end.

Three kinds of evidence, all from prefix self-joins over the whole bank:

* a value is a strict prefix of a longer one of its field: in the sorted distinct texts all that continue a
  text follow it, so the next one tells. A stem with a longer copy is cut; an option may be a phrase that
  others go on from, so there this decides only where its tail says nothing;
* its tail, the last word (or part of one) with the two words before it, is a strict prefix of tails
  that go on elsewhere: the prefixes of every word in its context are counted as going on, as a stop, or
  as the end of a value, and joined with the tails by equality. A tail that never stops anywhere is cut; a
  phrase that ends values elsewhere, such as one that leads into the options, is whole. Ends say so only
  of a tail that is a word in its context: where nearly all uses are longer words, values cut within the
  same word have met, as happens in large banks. A question copied with all its texts counts once, so
  copies of a cut value don't make its tail a possible end;
* its source document holds no longer value, and values pile up at that length (characters or bytes).

Defined cases: null and blank values are whole; a sign of omission after the cut is set aside; a tail
seen nowhere else is judged by its last word, then left whole; equal values get equal results; values
without a source have no limit; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.llm.p02_confusables import _SUSPECT, consistent
from quaestio.llm.texts import OPTION, STEM
from quaestio.session import materialize, table

STOP_SHARE = 0.02  # a tail that stops in at least this share of its other uses is a possible end
CHANCE = 4.0  # stops to expect of a word in as many uses before their absence counts
PILE, PILE_SHARE = 4, 0.08  # values, and share of a source's own values, at its greatest length that make it a limit
SHORTEST = 20  # characters: no source has a shorter limit
LONG_WORD = 48  # letters up to which all prefixes of a word are counted; longer ones meet by their first so many
_CLOSERS = tuple(".!?:;\"'”’»)]%")
_SIGNS = tuple("….])-–—")
_OMISSION = r"(?:\s*(?:…|\.{3,}|\[\.{3}\]|\(\.{3}\)|\(…\)|[-–—])+)\s*$"


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(campo, registro_id, fonte, texto, primeira) of stems and options; fonte is the document of the questions.

    primeira: the question is the first of those with the same stem and options.
    """
    exams = table(spark, sf_dir, "provas_cadastradas").select(
        F.col("id").alias("prova_cadastrada_id"), F.col("documento_fonte_questoes_id").alias("fonte")
    )
    of = table(spark, sf_dir, "prova_cadastrada_questoes").select("prova_cadastrada_id", "questao_id")
    of = of.join(exams, "prova_cadastrada_id").groupBy("questao_id").agg(F.min("fonte").alias("fonte"))
    stems = table(spark, sf_dir, "questoes").select(
        F.lit(STEM).alias("campo"), F.col("id").alias("registro_id"), F.col("id").alias("questao_id"), F.col("enunciado").alias("texto")
    )
    options = table(spark, sf_dir, "alternativas").select(F.lit(OPTION).alias("campo"), F.col("id").alias("registro_id"), "questao_id", "texto")
    values = stems.unionByName(options).where(F.col("texto").rlike(r"\S"))
    h = F.xxhash64("campo", "texto")
    texts = values.where("questao_id IS NOT NULL").groupBy("questao_id").agg(F.bit_xor(h).alias("_h"), F.sum(F.shiftrightunsigned(h, 32)).alias("_s"))  # the sum tells equal options
    first = texts.groupBy("_h", "_s").agg(F.min("questao_id").alias("questao_id")).select("questao_id", F.lit(True).alias("primeira"))
    known = values.join(of, "questao_id", "left").join(first, "questao_id", "left")
    alone = F.col("questao_id").isNull()  # of no question, so no copy of one
    return known.select("campo", "registro_id", "fonte", "texto", F.coalesce("primeira", alone).alias("primeira"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))  # what is one blank already is left alone


def body(text: Column) -> Column:
    """A squeezed value without a sign of omission at its end."""
    cut = F.trim(F.regexp_replace(text, _OMISSION, ""))
    return F.when(F.right(text, F.lit(1)).isin(*_SIGNS), cut).otherwise(text)


_STOP = "\x01"  # at the end of a token after which there is a stop


def tokens(text: Column) -> Column:
    """Array of words of a squeezed text in lower case, digits as 9, without signs around; a stop after a word leaves _STOP at its end."""
    t = F.translate(F.lower(text), "0123456789", "9" * 10)
    t = F.regexp_replace(t, r"[.,;:!?…\"”’»)\]]+(?= |$)", _STOP)
    return F.split(F.regexp_replace(t, r"(?<=^| )[(\[\"“‘«]+", ""), " ")


def bare(word: Column) -> Column:
    return F.translate(F.coalesce(word, F.lit("")), _STOP, "")


def word_at(toks: str, k) -> Column:
    return bare(F.get(F.col(toks), k))


def tail_uses(values: DataFrame) -> DataFrame:
    """(w2, w1, w, vai, para, fim): in how many places a word after two others goes on, stops, or ends a value.

    The end of a value that stands at its source's limit (``no_limite``) counts as neither. Copies of a
    question count once (``primeira``).
    """
    t = values.where("primeira").select(tokens(F.col("corpo")).alias("t"), "no_limite")
    empty = F.lit("")
    shifted = F.arrays_zip(F.concat(F.array(empty, empty), "t").alias("a"), F.concat(F.array(empty), "t").alias("b"), F.col("t").alias("c"))
    p = t.select("no_limite", F.size("t").alias("n"), F.posexplode(shifted).alias("k", "z")).where("k < n")
    p = p.select(
        bare(F.col("z")["a"]).alias("w2"), bare(F.col("z")["b"]).alias("w1"), bare(F.col("z")["c"]).alias("w"),
        F.endswith(F.col("z")["c"], F.lit(_STOP)).alias("stop"), (F.col("k") == F.col("n") - 1).alias("fim"), "no_limite",
    )
    p = p.where("w <> '' AND NOT (fim AND no_limite)")
    stops = F.col("stop")
    return p.groupBy("w2", "w1", "w").agg(
        F.count_if(~stops & ~F.col("fim")).alias("vai"), F.count_if(stops).alias("para"), F.count_if(~stops & F.col("fim")).alias("fim")
    )


def judged_tails(open_values: DataFrame, uses: DataFrame) -> DataFrame:
    """(w2, w1, w, cortada) of the distinct tails of unclosed values: true cut, false a possible end, null unseen.

    The widest context of two, one or no words before in which the tail occurs decides: by a stop it is
    an end; as nothing but the start of longer words it is cut; where it only goes on it is cut, unless
    the word ends phrases so often elsewhere that chance may explain why it doesn't here. After two words,
    stops don't count where longer words make up all but STOP_SHARE of what begins so.
    """
    own = F.count_if(F.col("primeira") & ~F.col("no_limite"))  # ends of the judged values themselves
    judged = materialize(open_values.where("w <> ''").groupBy("w2", "w1", "w").agg(own.alias("proprias")))
    for k, context in enumerate((["w2", "w1"], ["w1"], [])):
        keys = [*context, "w"]
        mine = judged.select(*keys).distinct()
        known = uses.join(mine.select(*context).distinct(), context, "left_semi") if context else uses
        known = known.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("vai", "para", "fim")]).withColumnRenamed("w", "outra")
        sums = _prefix_uses(mine, known, context, k)
        judged = judged.join(sums, keys, "left").fillna(0).withColumn(f"para{k}", F.col(f"para{k}") - F.least("proprias", F.lit(1)))
    judged = materialize(judged)
    share = F.greatest(F.col("para2"), F.lit(0)) / F.greatest(F.col("vai2") + F.col("para2"), F.lit(1))
    verdict = F.lit(None).cast("boolean")
    for k in (2, 1, 0):
        go, stop, longer = F.col(f"vai{k}"), F.col(f"para{k}"), F.col(f"longas{k}")
        ends = (stop > 0) & (stop >= STOP_SHARE * (go + stop))
        if k == 0:  # without two words before it, a short word shares its letters with too many others
            ends &= go + stop >= STOP_SHARE * (go + stop + longer)
        surely = (share < STOP_SHARE) | (go * share >= CHANCE)
        here = F.when(ends, F.lit(False)).when(go > 0, surely).when(longer > 0, F.lit(True))
        verdict = F.coalesce(here, verdict)
    return judged.select("w2", "w1", "w", verdict.alias("cortada"))


def _prefix_uses(mine: DataFrame, known: DataFrame, context: list[str], k: int) -> DataFrame:
    """(*context, w, vai{k}, para{k}, longas{k}): how the words of a context that begin with w are used: w itself, and longer ones.

    Every prefix of a known word is a row, summed up before it meets the tails, one row each; so the work
    grows with the letters of the words. Prefixes of words beyond LONG_WORD letters would be too many: longer
    tails meet longer words by their first LONG_WORD letters.
    """

    def sums(df: DataFrame) -> DataFrame:
        same = F.col("outra") == F.col("w")
        return df.groupBy(*context, "w").agg(
            F.sum(F.when(same, F.col("vai")).otherwise(0)).alias(f"vai{k}"),
            F.sum(F.when(same, F.col("para") + F.col("fim")).otherwise(0)).alias(f"para{k}"),
            F.sum(F.when(same, 0).otherwise(F.col("vai") + F.col("para") + F.col("fim"))).alias(f"longas{k}"),
        )

    ends = F.sequence(F.lit(1), F.least(F.length("outra"), F.lit(LONG_WORD)))
    short = sums(known.select("*", F.explode(F.transform(ends, lambda n: F.substring(F.col("outra"), F.lit(1), n))).alias("w")))
    short = mine.where(F.length("w") <= LONG_WORD).join(short, [*context, "w"])
    head = lambda c: F.substring(c, 1, LONG_WORD).alias("_h")
    long = mine.where(F.length("w") > LONG_WORD).select("*", head("w"))
    long = long.join(known.where(F.length("outra") > LONG_WORD).select("*", head("outra")), [*context, "_h"])
    return short.unionByName(sums(long.where(F.col("outra").startswith(F.col("w")))))


def continued(forms: DataFrame) -> DataFrame:
    """Of distinct texts (campo, f), those that another one of their field continues.

    Ranges of the sorted texts are each sorted in a task; the first text of the next range stands after
    the last one of a range.
    """
    parts = materialize(forms.repartitionByRange("campo", "f").withColumn("_p", F.spark_partition_id()))
    row = F.struct("campo", "f")
    first = parts.groupBy("_p").agg(F.min(row).alias("_first"))
    after = first.select("_p", F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy("_p")).alias("_after"))  # a row a range
    following = F.coalesce(F.lead(row).over(Window.partitionBy("_p").orderBy("campo", "f")), "_after")
    pairs = parts.join(F.broadcast(after), "_p").select("campo", "f", following.alias("_next"))
    return pairs.where((F.col("_next.campo") == F.col("campo")) & F.col("_next.f").startswith(F.col("f"))).select("campo", "f")


def longer_copies(open_values: DataFrame, values: DataFrame) -> DataFrame:
    """(campo, registro_id) of values whose body is a strict prefix of another of their field that goes on in letters or digits.

    Signs at the end are set aside on both sides, so whatever continues a form adds a letter or digit.
    """
    form = F.regexp_replace(F.lower("corpo"), r"[^\p{L}\p{N}]+$", "").alias("f")
    forms = values.select("campo", form).where("f <> ''").distinct()
    mine = open_values.select("campo", "registro_id", form)
    return mine.join(continued(forms), ["campo", "f"]).select("campo", "registro_id")


def limits(values: DataFrame) -> DataFrame:
    """(campo, fonte, limite, limite_bytes) of sources whose values pile up at their greatest length."""
    sized = values.where("fonte IS NOT NULL").select("campo", "fonte", "c", "b")
    tops = sized.groupBy("campo", "fonte").agg(F.max("c").alias("mc"), F.max("b").alias("mb"), F.count("*").alias("n"))
    piled = sized.groupBy("campo", "fonte", "c", "b").agg(F.count("*").alias("k")).join(tops, ["campo", "fonte"])
    piled = piled.groupBy("campo", "fonte", "mc", "mb", "n").agg(
        F.sum(F.when(F.col("c") >= F.col("mc") - 1, F.col("k")).otherwise(0)).alias("pc"),
        F.sum(F.when(F.col("b") >= F.col("mb") - 3, F.col("k")).otherwise(0)).alias("pb"),
    )
    enough = F.greatest(F.lit(PILE), F.col("n") * PILE_SHARE)
    by_chars, by_bytes = (F.col("pc") >= enough) & (F.col("pc") >= F.col("pb")), (F.col("pb") >= enough) & (F.col("pb") > F.col("pc"))
    return piled.where((by_chars | by_bytes) & (F.col("mc") > SHORTEST)).select("campo", "fonte", F.when(by_chars, F.col("mc")).alias("limite"), F.when(by_bytes, F.col("mb")).alias("limite_bytes"))


def normal(values: DataFrame) -> DataFrame:
    """The values in the consistent form of problem 2, so that disguised letters don't make words of their own."""
    form = F.pandas_udf(lambda t: t.map(consistent), "string")
    joined = F.regexp_replace("texto", r"(\p{L})[-¬\u00AD][ \t]*\r?\n\s*(\p{Ll})", "$1$2")  # words split over lines
    plain = values.withColumn("normal", F.when(F.contains("texto", F.lit("\n")), joined).otherwise(F.col("texto")))
    return plain.where("NOT _odd").unionByName(plain.where("_odd").withColumn("normal", form("normal"))).drop("_odd")


def assessed(values: DataFrame) -> DataFrame:
    """Unclosed values with their evidence: (campo, registro_id, fonte, texto, cortada, copia, no_limite)."""
    # with its source, lengths and whether it may be disguised: joined and tested once
    lengths = F.length("texto").alias("c"), F.octet_length("texto").alias("b"), F.col("texto").rlike(_SUSPECT).alias("_odd")
    values = materialize(values.select("campo", "registro_id", "fonte", "texto", "primeira", *lengths))
    limit = materialize(limits(values))
    at_limit = (F.col("c") >= F.col("limite") - 1) | (F.col("b") >= F.col("limite_bytes") - 3)
    values = values.join(limit, ["campo", "fonte"], "left").withColumn("no_limite", F.coalesce(at_limit, F.lit(False)))
    values = normal(values.drop("limite", "limite_bytes", "c", "b"))
    values = values.select("campo", "registro_id", "fonte", squeezed(F.col("normal")).alias("texto"), "primeira", "no_limite")
    values = materialize(values.withColumn("corpo", body(F.col("texto"))))
    unclosed = values.where(~F.right("corpo", F.lit(1)).isin(*_CLOSERS)).withColumn("t", tokens(F.col("corpo")))
    unclosed = materialize(
        unclosed.select(
            "campo", "registro_id", "fonte", "texto", "corpo", "primeira", "no_limite",
            word_at("t", F.size("t") - 3).alias("w2"), word_at("t", F.size("t") - 2).alias("w1"), word_at("t", F.size("t") - 1).alias("w"),
        )
    )
    tails = judged_tails(unclosed, materialize(tail_uses(values)))
    copies = longer_copies(unclosed, values).withColumn("copia", F.lit(True))
    out = unclosed.join(tails, ["w2", "w1", "w"], "left").join(copies, ["campo", "registro_id"], "left")
    return out.select("campo", "registro_id", "fonte", "texto", "cortada", F.coalesce("copia", F.lit(False)).alias("copia"), "no_limite")


def truncated(values: DataFrame) -> DataFrame:
    """(campo, registro_id, fonte) of cut values.

    A cut tail decides. A tail that is a possible end is still cut where a stem has a longer copy or
    stands at its source's limit, and where an option at the limit is a sentence (a capital first). A tail
    seen nowhere else is cut at the limit, before a sign of omission, and where the value has a longer copy.
    """
    a = assessed(values)
    sentence = F.col("texto").rlike(r"^\p{Lu}")
    sign = F.col("texto").rlike(r"[\p{L}\p{N}](?:…|\.{3,}|-)$")
    unsure = F.col("cortada").isNull() & (F.col("no_limite") | sign | F.col("copia"))
    stem = F.col("campo") == STEM
    ends = F.col("cortada") == F.lit(False)
    cut = F.col("cortada") | unsure | (ends & F.col("copia") & stem) | (ends & F.col("no_limite") & (stem | sentence))
    return a.where(F.coalesce(cut, F.lit(False))).select("campo", "registro_id", "fonte")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lost their end."""
    return truncated(sourced(spark, sf_dir)).select("campo", "registro_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field each source document cuts."""
    values = sourced(spark, sf_dir)
    cut = truncated(values).groupBy("campo", "fonte").agg(F.count("*").alias("n_cortados"))
    total = values.groupBy("campo", "fonte").agg(F.count("*").alias("n_valores"))
    joined = total.join(cut.withColumnRenamed("campo", "c").withColumnRenamed("fonte", "f"), (F.col("campo") == F.col("c")) & F.col("fonte").eqNullSafe(F.col("f")), "left")
    n = F.coalesce("n_cortados", F.lit(0))
    return joined.select("campo", F.col("fonte").alias("documento_fonte_id"), "n_valores", n.alias("n_cortados"), F.round(n / F.col("n_valores"), 6).alias("taxa"))


QUERIES = {"p7_found": p7_found, "p7_rates": p7_rates}
SQL: dict[str, str] = {}
