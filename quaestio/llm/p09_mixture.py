"""Problem 9: mixing sources to target weights by weighted fair queueing.

Each document, repeated up to its source's cap, queues in its source in a keyed random order (first
all first copies, then all second ones, and so on). Its virtual finish time is the cumulative tokens
of its source up to and with it, divided by the source's target share. All queues are merged in the
order of finish times and cut where the total budget is reached, so at any cut every source that is
not used up has its share to within one document.

Cumulative sums run in two levels: a sum for each of ``BUCKETS`` or more ranges of the order, then inside one
range; a source or a stretch of time is never gathered in one task, however large it is.

The budget is ``total_tokens``; by default it is the largest at which no source runs out before its
share, min(capacity / share). Defined cases: documents without text, without tokens or of a source
without target are left out; shares are normalized to sum 1; a cap below 1 leaves a source out; equal
finish times are ordered by source, id and copy; empty tables give an empty result.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestio.session import materialize, spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # on the driver, which sends the file to every executor
TOKENIZER_CONF = "spark.quaestio.tokenizer"  # where a session names another file
BUCKETS = 1024  # least number of ranges of an order; more where a range would exceed RANGE_ROWS rows
RANGE_ROWS = 500_000
SEED = "mistura-1"
#: Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """(id, *keep, tokens) with the number of tokens of each whole text."""
    path = tokenizer or df.sparkSession.conf.get(TOKENIZER_CONF, None) or TOKENIZER
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    cols = df.select(id_col, *keep, text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])

    def run(batches):
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            tokens = [len(enc.encode_ordinary(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tokens, pa.int64())], names=[*batch.schema.names[:-1], "tokens"]
            )

    return spread(cols.where(F.col(text_col).isNotNull())).mapInArrow(run, f"{fields}, tokens long")


def running_sum(df: DataFrame, group: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, in the order of (bucket, *order), for each group.

    ``bucket`` must be monotone in the order. Only the sums of buckets, few a group, meet
    in one window.
    """
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(*group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_in", F.sum(value).over(inside)).join(sums, [*group, "_b"])
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")


def targets(goals: DataFrame) -> DataFrame:
    """(source, share, cap) of sources that take part; repeated rows of a source count once."""
    ok = goals.where("source IS NOT NULL AND parcela_alvo > 0 AND max_repeticoes >= 1")
    ok = ok.groupBy("source").agg(F.max("parcela_alvo").alias("share"), F.max("max_repeticoes").alias("cap"))
    whole = F.sum("share").over(Window.partitionBy(F.lit(0)))  # the rows are one a source
    return ok.select("source", (F.col("share") / whole).alias("share"), "cap")


def mix(counted: DataFrame, goals: DataFrame, total_tokens: int | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, copia, tokens, fim_virtual, tokens_ate_aqui) of the chosen documents, in the order of the last."""
    goal = targets(goals)
    docs = counted.where("tokens > 0 AND doc_id IS NOT NULL")
    buckets = max(BUCKETS, docs.count() // RANGE_ROWS)
    sized = docs.groupBy("source").agg(F.sum("tokens").alias("have")).join(goal, "source")
    if total_tokens is None:
        most = sized.agg(F.min(F.floor(F.col("have") * F.col("cap") / F.col("share")))).first()[0]
        total_tokens = int(most or 0)
    queued = docs.join(goal, "source").select(
        "doc_id", "source", "tokens", "share", F.explode(F.sequence(F.lit(1), "cap")).alias("copia"), "cap"
    )
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("copia").cast("string")))
    queued = queued.withColumn("_u", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))  # 60 bits
    # the order (copia, _u) in ranges: cap equal parts, each of buckets / cap ranges of the hash
    width = F.greatest(F.lit(1), F.floor(F.lit(buckets) / F.col("cap")))
    unit = F.col("_u") / F.lit(float(2**60))
    part = (F.col("copia") - 1) * width + F.least(F.floor(unit * width), width - 1)
    queued = running_sum(queued, ["source"], part.cast("long"), ["copia", "_u", "doc_id"], "tokens", "_cum")
    timed = queued.withColumn("fim_virtual", F.col("_cum") / F.col("share"))
    span = materialize(timed.select("fim_virtual", "tokens", "source", "doc_id", "copia"))  # read three times
    horizon = _horizon(span, total_tokens)
    chosen = span.where(F.col("fim_virtual") <= F.lit(horizon))
    step = F.lit(max(horizon, 1.0) / buckets)
    chosen = running_sum(
        chosen.withColumn("_g", F.lit(0)), ["_g"], F.floor(F.col("fim_virtual") / step).cast("long"),
        ["fim_virtual", "source", "doc_id", "copia"], "tokens", "tokens_ate_aqui",
    )
    return chosen.where(F.col("tokens_ate_aqui") <= F.lit(total_tokens)).select("doc_id", "source", "copia", "tokens", "fim_virtual", "tokens_ate_aqui")


def _horizon(span: DataFrame, total_tokens: int) -> float:
    """A finish time by which the whole queue holds the budget: it narrows what is sorted.

    Sums over ranges of equal width; where the queue holds less than the budget, its last finish time.
    """
    top = span.agg(F.max("fim_virtual")).first()[0]
    if top is None:
        return 0.0
    fine = 4096
    sums = (
        span.groupBy(F.least(F.floor(F.col("fim_virtual") / F.lit(top / fine)), F.lit(fine - 1)).alias("b"))
        .agg(F.sum("tokens").alias("s"))
        .orderBy("b")
        .collect()
    )
    total = 0
    for b, s in sums:
        total += s
        if total >= total_tokens:
            return float(top) if b == fine - 1 else float(top) * (b + 1) / fine
    return float(top)


def shares(chosen: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source with a target: share wanted and reached, tokens, documents and most copies of one."""
    by = chosen.groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("n_documentos"), F.max("copia").alias("max_copias")
    )
    out = targets(goals).join(by, "source", "left")
    out = out.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # the rows are one a source
    return out.select(
        "source",
        F.round("share", 6).alias("parcela_alvo"),
        F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("parcela_obtida"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_documentos", F.lit(0)).alias("n_documentos"),
        F.coalesce("max_copias", F.lit(0)).alias("max_copias"),
        F.col("cap").alias("max_repeticoes"),
    )


def _chosen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    goals = table(spark, sf_dir, "metas_mistura")
    counted = materialize(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"]))
    return mix(counted, goals), goals


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: each use of a document with its place in the queue."""
    return _chosen(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens that the mixed corpus reaches."""
    return shares(*_chosen(spark, sf_dir))


def p9_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queue with sizes in characters, which SQL can count."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("tokens"))
    return mix(sized, table(spark, sf_dir, "metas_mistura")).select("doc_id", "source", "copia", "tokens", "tokens_ate_aqui")


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_by_length": p9_by_length}
SQL = {
    "p9_by_length": f"""WITH g0 AS (SELECT source, max(parcela_alvo) AS share, max(max_repeticoes) AS cap FROM metas_mistura WHERE source IS NOT NULL AND parcela_alvo > 0 AND max_repeticoes >= 1 GROUP BY 1),
g AS (SELECT source, share / sum(share) OVER () AS share, cap FROM g0), d AS (SELECT doc_id, source, length(text) AS n, share, cap FROM documents JOIN g USING (source) WHERE length(text) > 0 AND doc_id IS NOT NULL),
b AS (SELECT min(floor(have * cap / share)) AS total FROM (SELECT sum(n) AS have, any_value(cap) AS cap, any_value(share) AS share FROM d GROUP BY source)),
q AS (SELECT doc_id, source, n, share, unnest(range(1, cap + 1))::INTEGER AS copia FROM d), u AS (SELECT *, ('0x' || substr(md5('{SEED}|' || doc_id || '|' || copia), 1, 15))::BIGINT AS u FROM q),
t AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY copia, u, doc_id) / share AS fim FROM u),
c AS (SELECT *, sum(n) OVER (ORDER BY fim, source, doc_id, copia ROWS UNBOUNDED PRECEDING) AS ate FROM t)
SELECT doc_id, source, copia, n AS tokens, ate::BIGINT AS tokens_ate_aqui FROM c, b WHERE ate <= total"""
}
