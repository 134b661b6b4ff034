"""Equality joins of which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.session import checkpoint

PAIRS = 2_000_000  # row pairs of one key that one task may join


def salted_join(a: DataFrame, b: DataFrame, keys: list[str], at_most: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """The inner join of ``a`` and ``b`` on ``keys`` (never null in it), whatever the share of one key.

    Both sides are counted by key first. A key whose row pairs exceed ``pairs`` is divided: the rows of ``b``
    go to as many salts as it takes, and each row of ``a`` to every one of these. Where no key is that
    frequent, the join stays plain. Rows are salted by their whole content, so equal rows stay together, as
    they must anyway. ``at_most`` is a bound on the row pairs of one key that the caller knows: up to ``pairs``,
    nothing is counted.
    """
    if at_most is not None and at_most <= pairs:
        return a.join(b, keys)
    size = a.groupBy(*keys).agg(F.count("*").alias("_na")).join(b.groupBy(*keys).agg(F.count("*").alias("_nb")), keys)
    parts = F.least(F.col("_nb"), F.ceil(F.col("_na") * F.col("_nb") / pairs)).cast("int")
    hot = checkpoint(size.select(*keys, parts.alias("_parts")).where("_parts > 1"))
    if hot.isEmpty():
        return a.join(b, keys)
    n = F.coalesce("_parts", F.lit(1))
    left = a.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    right = b.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*b.columns), n).cast("int")).drop("_parts")
    return left.join(right, [*keys, "_salt"]).drop("_salt")
