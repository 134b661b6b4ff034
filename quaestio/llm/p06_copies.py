"""Problem 6: records that differ only in formatting.

A record's canonical form keeps letters and digits in lower case; its key is a 128-bit digest of that.
Keys are counted exactly (partial counts in each task, then one row a key). Keys with at least
1/HOT_PARTS of all rows are hot; there are at most HOT_PARTS of them, which bounds what is broadcast.
Their rows are spread over salts and aggregated in two levels, and joined back by broadcast; the other
keys take one shuffle. The representative is the record of smallest id. Both queries go this way.

Defined cases: null equals empty; texts under ``MIN_LENGTH`` letters and digits are left out; a raw
record that is no JSON object is compared by its own letters and digits; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.llm.texts import hot_limit
from quaestio.session import materialize, table

SALTS = 64
MIN_LENGTH = 40


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def keyed_questions(df: DataFrame, *payload: str) -> DataFrame:
    """(registro_id, chave, *payload) of questions whose stem is long enough."""
    stem = letters_and_digits(F.col("enunciado"))
    key = F.unhex(F.md5(F.concat_ws("\x1f", "_stem", letters_and_digits(F.col("banca")))))
    df = df.select("id", "enunciado", "banca", stem.alias("_stem")).where(F.length("_stem") >= MIN_LENGTH)
    return df.select(F.col("id").alias("registro_id"), key.alias("chave"), *payload)


def keyed_raw(df: DataFrame) -> DataFrame:
    fields = F.map_entries(F.from_json("registro", "map<string,string>"))
    parts = F.array_sort(
        F.transform(fields, lambda e: F.concat_ws("\x1f", F.lower(F.trim(e["key"])), letters_and_digits(e["value"])))
    )
    form = F.coalesce(F.array_join(parts, "\x1e"), F.concat(F.lit("\x1d"), letters_and_digits(F.col("registro"))))
    return df.where("registro IS NOT NULL").select("registro_id", F.unhex(F.md5(form)).alias("chave"))


def hot_keys(keyed: DataFrame) -> DataFrame:
    """(chave) of the keys that hold at least 1/HOT_PARTS of all rows: at most HOT_PARTS rows, counted exactly."""
    counts = materialize(keyed.groupBy("chave").agg(F.count("*").alias("n")))
    return materialize(counts.where(F.col("n") >= hot_limit(counts.agg(F.sum("n")).first()[0] or 0)).select("chave"))


def grouped(keyed: DataFrame, hot: DataFrame, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """(of hot keys, of the others): (chave, r, copias), r the record of smallest id with its payload.

    Rows of hot keys are aggregated by key and salt, then by key; the others by key at once.
    """
    first, few = F.min(F.struct("registro_id", *payload)).alias("r"), F.broadcast(hot)
    salted = keyed.join(few, "chave", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("registro_id"), F.lit(SALTS)))
    two = salted.groupBy("chave", "_salt").agg(first, F.count("*").alias("_n"))
    two = two.groupBy("chave").agg(F.min("r").alias("r"), F.sum("_n").alias("copias"))
    one = keyed.join(few, "chave", "left_anti").groupBy("chave").agg(first, F.count("*").alias("copias"))
    return two, one


def members(keyed: DataFrame) -> DataFrame:
    """(registro_id, grupo_id) of every record that has a copy."""
    keyed = materialize(keyed)
    hot = hot_keys(keyed)
    two, one = ((g.where("copias > 1").select("chave", F.col("r.registro_id").alias("grupo_id"))) for g in grouped(keyed, hot, []))
    few = F.broadcast(hot)
    rest = keyed.join(few, "chave", "left_anti").join(one, "chave")
    return keyed.join(F.broadcast(two), "chave").unionByName(rest).select("registro_id", "grupo_id")


def collapse(keyed: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each canonical form: the record of smallest id with its payload, and the number of copies."""
    two, one = grouped(keyed, hot_keys(keyed.select("chave")), payload)
    return one.unionByName(two).select("r.registro_id", *[f"r.{c}" for c in payload], "copias")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a copy, and the smallest id of its group."""
    out = None
    for origin, key in (("questoes", keyed_questions), ("importacoes_brutas", keyed_raw)):
        part = members(key(table(spark, sf_dir, origin))).select(F.lit(origin).alias("origem"), "registro_id", "grupo_id")
        out = part if out is None else out.unionByName(part)
    return out


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each stem and board, with the number of copies it stands for."""
    return collapse(keyed_questions(table(spark, sf_dir, "questoes"), "enunciado", "banca"), ["enunciado", "banca"])


QUERIES = {"p6_found": p6_found, "p6_collapsed": p6_collapsed}

_NORM = r"regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_Q = f"""q AS (SELECT id AS registro_id, enunciado, banca, {_NORM.format('enunciado')} AS s, {_NORM.format('banca')} AS b FROM questoes),
qk AS (SELECT *, count(*) OVER (PARTITION BY s, b) AS n, min(registro_id) OVER (PARTITION BY s, b) AS g FROM q WHERE length(s) >= {MIN_LENGTH})"""

SQL = {
    "p6_found": f"""WITH {_Q}, i AS (
  SELECT registro_id, list_sort(list_transform(json_keys(registro), lambda k: lower(trim(k)) || chr(31)
    || {_NORM.format("json_extract_string(registro, '$.\"' || k || '\"')")})) AS f FROM importacoes_brutas
), ik AS (SELECT *, count(*) OVER (PARTITION BY f) AS n, min(registro_id) OVER (PARTITION BY f) AS g FROM i)
SELECT 'questoes' AS origem, registro_id, g AS grupo_id FROM qk WHERE n > 1
UNION ALL SELECT 'importacoes_brutas', registro_id, g FROM ik WHERE n > 1""",
    "p6_collapsed": f"WITH {_Q} SELECT registro_id, enunciado, banca, n AS copias FROM qk WHERE registro_id = g",
}
