"""The text fields of the question bank that several operators read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.session import table


def fields(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(campo, registro_id, texto) of fields such as ``questoes.enunciado``; nulls are left out."""
    parts = []
    for name in names:
        source, column = name.split(".")
        df = table(spark, sf_dir, source).where(F.col(column).isNotNull() & F.col("id").isNotNull())
        parts.append(df.select(F.lit(name).alias("campo"), F.col("id").cast("long").alias("registro_id"), F.col(column).alias("texto")))
    return reduce(DataFrame.unionByName, parts)


HOT_PARTS = 256


def hot_limit(total: int) -> int:
    """The least rows of a hot key: a 1/HOT_PARTS share of ``total``, so at most HOT_PARTS keys are hot at any size."""
    return max(2, -(-total // HOT_PARTS))


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``groups``, one row a key, whose ``count`` tells how many of ``rows`` each key has.

    Hot keys, at most HOT_PARTS of them, are joined by broadcast, the others by a shuffle, so no key is
    gathered in one task. ``groups`` is read several times: a written table.
    """
    limit = hot_limit(groups.agg(F.sum(count)).first()[0] or 0)
    few = F.broadcast(groups.where(F.col(count) >= limit))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(groups.where(F.col(count) < limit), keys)
    return rows.join(few, keys).unionByName(rest)


STEM, OPTION, SUPPORT = "questoes.enunciado", "alternativas.texto", "questoes.texto_apoio"
