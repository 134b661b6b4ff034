"""Order-dependent operators in two levels, so no group and no whole table is sorted in one task.

Rows are put into ranges by a deterministic expression that is monotone in the order; a small table with
one row a range carries what the later ranges need of the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_numbers(df: DataFrame, group: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with the row number, from 1, in each group by (bucket, order)."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = df.withColumn("_i", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    keys = [*group, "_b"]
    s = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = inside.join(s, on)
    return joined.withColumn(name, (F.col("_before") + F.col("_i")).cast("int")).drop("_b", "_i", "_before", *[f"_k{i}" for i in range(len(keys))])


def gap_sessions(df: DataFrame, order: str, time: str, seconds: int, width: int = 100_000) -> DataFrame:
    """``df`` with ``sessao`` from 1, over all rows in the order of a numeric column.

    A session starts where the time since the row before exceeds ``seconds``, runs backwards, or where
    one of the two times is null. Ranges are ``width`` values of the order column.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / width))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ends = df.groupBy("_b").agg(F.max_by(at, order).alias("_last"))
    ends = ends.withColumn("_carry", F.lag("_last").over(Window.partitionBy(F.lit(0)).orderBy("_b"))).select("_b", "_carry")
    w = Window.partitionBy("_b").orderBy(order)
    rows = df.join(ends, "_b").withColumn("_first", F.row_number().over(w) == 1)
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.lag(at).over(w))
    gap = at - before
    rows = rows.withColumn("_new", F.coalesce((gap > seconds * 1_000_000) | (gap < 0), F.lit(True)).cast("int"))
    sums = rows.groupBy("_b").agg(F.sum("_new").alias("_s"))
    ahead = F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_ahead", ahead).select("_b", "_ahead")
    rows = rows.withColumn("_in", F.sum("_new").over(w)).join(sums, "_b")
    return rows.withColumn("sessao", F.col("_ahead") + F.col("_in")).drop("_b", "_carry", "_first", "_new", "_in", "_ahead")
