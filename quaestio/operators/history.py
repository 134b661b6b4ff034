"""Append-only history: versions by content, sources by digest, staged proposals, overlays.

Nothing is updated in place: each operator gives the rows to append, or the table as it is after them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of a row: fields in the order of their names, nulls included."""
    fields = F.struct(*[F.col(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def versions_to_append(current: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """(key, numero_versao, hash_conteudo) of contents that differ from their latest version; equal ones add nothing.

    current: key, hash_conteudo. log: key, numero_versao, hash_conteudo.
    """
    last = latest(log, key, "numero_versao").select(key, F.col("numero_versao").alias("_n"), F.col("hash_conteudo").alias("_h"))
    j = current.join(last, key, "left").where(F.col("_h").isNull() | (F.col("_h") != F.col("hash_conteudo")))
    return j.select(key, (F.coalesce("_n", F.lit(0)) + 1).alias("numero_versao"), "hash_conteudo")


def upsert_sources(have: DataFrame, new: DataFrame, digest: str, order: str) -> DataFrame:
    """Sources after new ones: one row a digest, the oldest kept, its place taken from the newest that has one.

    Rows without a digest are each a source of their own.
    """
    both = have.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in have.columns if c not in (digest, "localizacao")]
    known = both.where(F.col(digest).isNotNull())
    place = F.max_by("localizacao", F.when(F.col("localizacao").isNotNull(), F.struct("_new", order)))
    one = known.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct("_new", order)).alias("_r"), place.alias("localizacao"))
    kept = one.select(digest, "localizacao", *[F.col(f"_r.{c}").alias(c) for c in rest])
    return kept.select(*have.columns).unionByName(both.where(F.col(digest).isNull()).select(*have.columns))


def insert_or_ignore(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``have`` with the new rows whose key it lacks; repeated new keys count once."""
    first = new.dropDuplicates([key]).join(have.select(key), key, "left_anti")
    return have.unionByName(first.select(*have.columns))


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def overlay(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the non-null values of ``changes`` in place of its own."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in fields])
    j = current.join(c, key, "left")
    return j.select(*[F.coalesce(f"_{x}", x).alias(x) if x in fields else x for x in current.columns])


def field_differences(df: DataFrame, fields: list[str], current: str, proposed: str) -> DataFrame:
    """``df`` with ``diferencas``: name=current>proposed of the fields that differ; empty equals null."""
    parts = []
    for f in fields:
        a, b = F.coalesce(F.col(f"{current}{f}").cast("string"), F.lit("")), F.coalesce(F.col(f"{proposed}{f}").cast("string"), F.lit(""))
        parts.append(F.when(a != b, F.concat(F.lit(f"{f}="), a, F.lit(">"), b)))
    return df.withColumn("diferencas", F.array_join(F.array_compact(F.array(*parts)), "; "))


def apply_if_unchanged(proposals: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(proposal columns, resultado): a proposal applies only where the content it was made for is still there.

    If two proposals are for one key, none of them applies.
    """
    now = current.select(key, F.col("hash_conteudo").alias("_now"))
    several = F.count("*").over(Window.partitionBy(key)) > 1
    j = proposals.withColumn("_several", several).join(now, key, "left")
    state = F.when(F.col("_now").isNull(), "ausente").when(F.col("_several"), "concorrente").when(F.col("_now") != F.col("hash_esperado"), "alterada")
    return j.withColumn("resultado", state.otherwise("aplicada")).drop("_now", "_several")


def insert_questions(new: DataFrame, options: DataFrame, content: list[str], after: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, options, versions) to append for a batch of new questions (ref, ...), numbered on from ``after``.

    options: ref, letra, texto; only multiple-choice questions take theirs. Each question gets version 1 with
    the digest of its content. The three are of one batch: written to a new folder each, then put in place together.
    """
    from quaestio.operators.curation import rank_globally

    q = rank_globally(new, "ref").withColumn("id", F.col("_rank") + after + 1).drop("_rank")
    o = options.join(q.where("tipo = 'multipla_escolha'").select("ref", F.col("id").alias("questao_id")), "ref").drop("ref")
    v = q.select(F.col("id").alias("questao_id"), F.lit(1).alias("numero_versao"), signature(content).alias("hash_conteudo"))
    return q, o, v
