"""Curating labelled examples: lineage, splits without leaks, manifests, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.functions.text import comparison_text
from quaestio.operators.graph import connected_components
from quaestio.session import checkpoint


def merge_lineage(examples: DataFrame, image: str, label: str) -> DataFrame:
    """(image, label, grupos, fontes, situacao): one row an image; different labels of one image are an error."""
    agg = examples.groupBy(image).agg(
        F.min(label).alias(label), F.max(label).alias("_l"), F.array_sort(F.collect_set("grupo")).alias("grupos"), F.array_sort(F.collect_set("fonte")).alias("fontes")
    )
    return agg.withColumn("situacao", F.when(F.col(label) == F.col("_l"), "ok").otherwise("conflito")).drop("_l")


def component_edges(examples: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """(a, b): each example with the first of every key value it has; a star a value, so no pairs within one."""
    parts = []
    for k in keys:
        have = examples.where(F.col(k).isNotNull())
        first = have.groupBy(k).agg(F.min(id_col).alias("a"))
        parts.append(have.join(first, k).select("a", F.col(id_col).alias("b")))
    return reduce(DataFrame.unionByName, parts)


def split(examples: DataFrame, id_col: str, keys: list[str], every: int = 5) -> DataFrame:
    """(id, componente, particao): examples linked by a shared key value stay in one part.

    Components, ordered by their smallest id, go to validation at 0, ``every``, 2 * ``every`` and so on;
    a single component is all training. The order of components is a global rank, of one row each.
    """
    edges = component_edges(examples, id_col, keys)
    linked = connected_components(edges, "a", "b").withColumnRenamed("node", id_col)
    e = examples.select(id_col).distinct().join(linked, id_col, "left").withColumn("componente", F.coalesce("component", id_col)).drop("component")
    comps = e.select("componente").distinct()
    ranked = rank_globally(comps, "componente")
    n = comps.count()
    part = F.when(F.lit(n > 1) & (F.col("_rank") % every == 0), "validacao").otherwise("treino")
    return e.join(ranked, "componente").select(id_col, "componente", part.alias("particao"))


def rank_globally(df: DataFrame, order: str) -> DataFrame:
    """``df`` with ``_rank`` from 0 in the order of a column, without one task for all rows.

    Rows are range-partitioned; each partition's rows are numbered, then shifted by the sizes of those before.
    """
    parts = checkpoint(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_c")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return parts.withColumn("_i", inside).join(F.broadcast(sizes), "_p").withColumn("_rank", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def consensus(a: Column, b: Column, c: Column, current: Column, located: Column) -> tuple[Column, Column]:
    """(decision, text) of three readings of one place.

    The first two alone decide if they agree; else the third must agree with one of them. Texts agree in
    their comparing form. Nothing is approved by this; it only proposes.
    """

    def same(x, y):
        return comparison_text(x) == comparison_text(y)

    chosen = F.when(same(a, b), a).when(c.isNotNull() & (same(c, a) | same(c, b)), c)
    decision = (
        F.when(~located, "abster").when(same(a, b), F.lit("ok")).when(c.isNull() | (F.trim(c) == ""), "abster").when(same(c, a) | same(c, b), F.lit("ok")).otherwise("divergencia")
    )
    final = F.when(decision != "ok", decision).when(same(chosen, current), "manter").otherwise("proposta")
    return final, F.when(final == "proposta", chosen)


def precision_report(df: DataFrame, group: str, predicted: str, gold: str) -> DataFrame:
    """(group, n, previstas, corretas, precisao, cobertura) of each group and, with null, of all."""
    agg = df.rollup(group).agg(
        F.count("*").alias("n"), F.count(predicted).alias("previstas"), F.count_if(F.col(predicted) == F.col(gold)).alias("corretas")
    )
    precision = F.when(F.col("previstas") > 0, F.col("corretas") / F.col("previstas")).otherwise(0.0)
    return agg.withColumn("precisao", F.round(precision, 6)).withColumn("cobertura", F.round(F.col("previstas") / F.col("n"), 6))
