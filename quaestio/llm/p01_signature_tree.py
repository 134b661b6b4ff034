"""Problem 1: near-duplicate stems by signature trees.

Every stem becomes its set of word n-grams. Stems of one set form a class; work goes on with one
representative of each. Representatives meet in blocks of a common rare n-gram (the prefix filter:
two sets of the wanted similarity always share one n-gram among the rarest of each; n-grams are counted
exactly, and those of one set only never meet any). Inside a block a signature tree is built: leaves hold token bitmaps, inner nodes the OR of their children with the
range of sizes, and a dual traversal from (root, root) drops each pair of nodes whose largest
possible overlap is below the least overlap its sizes ask for. What is left is verified on the full
sets, so the result is exact.

Defined cases: null and short texts (under ``min_words`` words) belong to no pair; equal texts are
pairs of similarity 1; rows that repeat an id with another text count with one of the texts, that of the
smallest digest; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.llm.texts import join_counted
from quaestio.operators.graph import connected_components
from quaestio.operators.skew import salted_join
from quaestio.session import materialize, table

WORD = r"[\p{L}\p{N}]+"
LEAF = 32  # representatives in a leaf of the signature tree
CELL = 8192  # largest part of a block that one task holds at once
SIG_WORDS = 4  # 64-bit words of a bitmap


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, n: int, min_words: int) -> DataFrame:
    """(id, size, k1, k2, shingles): the sorted distinct hashes of word n-grams, and two hashes of the set."""
    base = df.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("w"))
    base = base.where(f"id IS NOT NULL AND size(w) >= {max(min_words, n)}")
    grams = F.transform(
        F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)])
    )
    base = base.select("id", F.array_sort(F.array_distinct(grams)).alias("shingles"))
    return base.select(
        "id",
        F.size("shingles").alias("size"),
        F.xxhash64(F.lit(1), "shingles").alias("k1"),
        F.xxhash64(F.lit(2), "shingles").alias("k2"),
        "shingles",
    )


def prefixes(heads: DataFrame, num: int, den: int) -> DataFrame:
    """(id, shingles, raros): with the n-grams of each set's prefix that other sets have as well, rarest first, as (n, h).

    n-grams are counted over all sets; those of a single set are the rarest of it and take the first places
    of its prefix, but need no block. Of a set's n-grams in the order (count, hash) the first
    size - ceil(size * num / den) + 1 are its prefix.
    """
    grams = heads.select("id", F.explode("shingles").alias("h"))
    shared = grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    lists = grams.join(shared, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("r"))
    size = F.size("shingles")
    places = size - F.ceil(size * num / den).cast("int") + 1 - (size - F.size("r"))
    return heads.join(lists, "id").where(places > 0).select("id", "shingles", F.slice("r", F.lit(1), places).alias("raros"))


def _bitmaps(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    u = h.view(np.uint64)
    bit = (u >> np.uint64(40)) & np.uint64(SIG_WORDS * 64 - 1)
    out = np.zeros(n_rows * SIG_WORDS, np.uint64)
    at = row * SIG_WORDS + (bit >> np.uint64(6)).astype(np.int64)
    np.bitwise_or.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n_rows, SIG_WORDS)


POSTING = pa.schema(
    [("token", pa.int64()), ("ci", pa.int32()), ("cj", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("size", pa.int32()), *[(f"s{k}", pa.int64()) for k in range(SIG_WORDS)]]
)


def _postings():
    """Emit each representative to the blocks of its prefix, with its bitmap.

    A block of more than CELL sets is divided into parts of about that many; a row then goes to the cell of
    each pair of parts that its own part belongs to, so no task holds the whole block.
    """

    def run(batches):
        for batch in batches:
            ids, grams, rare = (batch.column(k) for k in range(3))
            ids = ids.to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
            sig = _bitmaps(np.repeat(np.arange(len(ids)), sizes), grams.flatten().to_numpy(zero_copy_only=False), len(ids))
            row = np.repeat(np.arange(len(ids)), pa.compute.list_value_length(rare).to_numpy(zero_copy_only=False))
            df, h = (rare.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = np.maximum(1, -(-df // CELL))
            part = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts
            rep = np.repeat(np.arange(len(h)), parts)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
            side = part[rep]
            row = row[rep]
            yield pa.record_batch(
                [
                    pa.array(h[rep], pa.int64()),
                    pa.array(np.minimum(side, other).astype(np.int32)),
                    pa.array(np.maximum(side, other).astype(np.int32)),
                    pa.array(side.astype(np.int32)),
                    pa.array(ids[row]),
                    pa.array(sizes[row].astype(np.int32)),
                    *[pa.array(sig[row, k].view(np.int64)) for k in range(SIG_WORDS)],
                ],
                schema=POSTING,
            )

    return run


class SignatureTree:
    """Rows sorted by size and bitmap; level 0 are leaves of LEAF rows, each next level joins LEAF // 4 nodes."""

    def __init__(self, size: np.ndarray, sig: np.ndarray):
        self.order = np.lexsort((*sig.T, size))
        self.size, self.sig = size[self.order].astype(np.int64), sig[self.order]
        self.excess = self.size - np.bitwise_count(self.sig).sum(1).astype(np.int64)
        self.levels = []
        starts = np.arange(0, len(size), LEAF)
        low, high = np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts)
        bits, excess = np.bitwise_or.reduceat(self.sig, starts, 0), np.maximum.reduceat(self.excess, starts)
        self.levels.append((bits, low, high, excess))
        self.fan = LEAF // 4
        while len(low) > 1:
            starts = np.arange(0, len(low), self.fan)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            bits, excess = np.bitwise_or.reduceat(bits, starts, 0), np.maximum.reduceat(excess, starts)
            self.levels.append((bits, low, high, excess))


def _possible(a, b, i, j, num: int, den: int) -> np.ndarray:
    """Whether rows under nodes i and j may reach the similarity num / den.

    n-grams shared by two rows lie on shared bits; several on one bit are covered by the excess, the
    n-grams of a row beyond its set bits. So overlap <= shared bits + the smaller excess, and never
    above the smaller size; needed is num * (x + y) / (num + den), and sizes within den / num.
    """
    (abits, alow, ahigh, aex), (bbits, blow, bhigh, bex) = a, b
    shared = np.bitwise_count(abits[i] & bbits[j]).sum(1).astype(np.int64) + np.minimum(aex[i], bex[j])
    most = np.minimum(shared, np.minimum(ahigh[i], bhigh[j]))
    return (most * (num + den) >= num * (alow[i] + blow[j])) & (ahigh[i] * den >= blow[j] * num) & (bhigh[j] * den >= alow[i] * num)


def _children(i, j, n, m, same, fan):
    """The pairs of children of node pairs (i, j); of a tree with itself only those with i <= j."""
    k = np.arange(fan * fan)
    ci = (i[:, None] * fan + k[None, :] // fan).ravel()
    cj = (j[:, None] * fan + k[None, :] % fan).ravel()
    ok = (ci < n) & (cj < m)
    if same:
        ok &= ci <= cj
    return ci[ok], cj[ok]


def dual_traversal(a: SignatureTree, b: SignatureTree | None, num: int, den: int):
    """Yield (i, j): positions of rows that may be similar; ``b`` None joins ``a`` with itself."""
    same, b = b is None, a if b is None else b
    top = max(len(a.levels), len(b.levels))

    def level(t, k):
        return t.levels[min(k, len(t.levels) - 1)]

    i = j = np.zeros(1, np.int64)
    for k in range(top - 1, -1, -1):
        x, y = level(a, k), level(b, k)
        if k < top - 1:
            fa, fb = a.fan if k < len(a.levels) - 1 else 1, b.fan if k < len(b.levels) - 1 else 1
            fan = max(fa, fb)
            if fa == fb:
                i, j = _children(i, j, len(x[1]), len(y[1]), same, fan)
            else:
                c = np.arange(fan)
                wide, narrow = (i, j) if fa > fb else (j, i)
                wide, narrow = (wide[:, None] * fan + c).ravel(), np.repeat(narrow, fan)
                i, j = (wide, narrow) if fa > fb else (narrow, wide)
                ok = (i < len(x[1])) & (j < len(y[1]))
                i, j = i[ok], j[ok]
        ok = _possible(x, y, i, j, num, den)
        i, j = i[ok], j[ok]
    rows_a, rows_b = (a.sig, a.size, a.size, a.excess), (b.sig, b.size, b.size, b.excess)
    for lo in range(0, len(i), 512):  # 512 pairs of leaves, half a million pairs of rows at a time
        ri, rj = _children(i[lo : lo + 512], j[lo : lo + 512], len(a.size), len(b.size), False, LEAF)
        if same:
            ok = ri < rj
            ri, rj = ri[ok], rj[ok]
        ok = _possible(rows_a, rows_b, ri, rj, num, den)
        yield a.order[ri[ok]], b.order[rj[ok]]


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _small_groups(start, count, size, sig, num, den):
    """All blocks of one leaf at once: their row pairs, tested like any pair of leaves' rows."""
    excess = size - np.bitwise_count(sig).sum(1).astype(np.int64)
    rows = (sig, size, size, excess)
    for lo in range(0, len(start), 2000):
        s, c = start[lo : lo + 2000], count[lo : lo + 2000]
        left = np.repeat(s, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        after = np.repeat(s + c, c) - left - 1
        i = np.repeat(left, after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        ok = _possible(rows, rows, i, j, num, den)
        yield i[ok], j[ok]


def _join_blocks(num: int, den: int):
    """Rows arrive sorted by cell; each cell is joined by its own signature tree (or tree pair)."""

    def pairs(block):
        cols = [block.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        token, ci, cj, side, ids, size = cols
        size = size.astype(np.int64)
        sig = np.stack([block.column(6 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(SIG_WORDS)], 1)
        cut = np.flatnonzero((np.diff(token) != 0) | (np.diff(ci) != 0) | (np.diff(cj) != 0)) + 1
        start = np.concatenate(([0], cut))
        count = np.diff(np.concatenate((start, [len(token)])))
        small = (count > 1) & (count <= LEAF) & (ci[start] == cj[start])
        out = [(ids[i], ids[j]) for i, j in _small_groups(start[small], count[small], size, sig, num, den)]
        for s, c in zip(start[(count > 1) & ~small], count[(count > 1) & ~small]):
            at = np.arange(s, s + c)
            if ci[s] == cj[s]:
                tree = SignatureTree(size[at], sig[at])
                out += [(ids[at][i], ids[at][j]) for i, j in dual_traversal(tree, None, num, den)]
            else:
                left, right = at[side[at] == ci[s]], at[side[at] == cj[s]]
                if len(left) and len(right):
                    a, b = SignatureTree(size[left], sig[left]), SignatureTree(size[right], sig[right])
                    out += [(ids[left][i], ids[right][j]) for i, j in dual_traversal(a, b, num, den)]
        x = np.concatenate([p[0] for p in out]) if out else np.zeros(0, np.int64)
        y = np.concatenate([p[1] for p in out]) if out else np.zeros(0, np.int64)
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
        return pa.record_batch([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], schema=PAIR)

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            token, ci, cj = (now.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            last = np.flatnonzero((token != token[-1]) | (ci != ci[-1]) | (cj != cj[-1]))
            keep = last[-1] + 1 if len(last) else 0
            if keep:
                yield pairs(now.slice(0, keep))
            rest = now.slice(keep)
        if rest is not None and rest.num_rows > 1:
            yield pairs(rest)

    return run


def similar_sets(sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of ``shingle_sets``: (id, rep, copies) of each row, and (a, b) of similar representatives."""
    reps = materialize(sets.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    members = materialize(join_counted(sets.select("id", "k1", "k2"), reps, ["k1", "k2"], "copies").select("id", "rep", "copies"))
    heads = materialize(sets.join(members.where("id = rep").select("id"), "id").groupBy("id").agg(F.min_by("shingles", "k1").alias("shingles")))
    posted = prefixes(heads, num, den).mapInArrow(_postings(), _ddl(POSTING))
    blocks = posted.repartition("token", "ci", "cj").sortWithinPartitions("token", "ci", "cj")
    found = blocks.mapInArrow(_join_blocks(num, den), "a long, b long").distinct()
    sizes = heads.select("id", "shingles")
    checked = found.join(sizes.toDF("a", "sa"), "a").join(sizes.toDF("b", "sb"), "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    similar = checked.where(overlap * (num + den) >= num * (F.size("sa") + F.size("sb"))).select("a", "b")
    return members, similar


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, n: int = 3, min_words: int = 25, num: int = 1, den: int = 2):
    """(members, similar) of the texts: see ``similar_sets``. num / den is the least Jaccard similarity."""
    sets = materialize(shingle_sets(df, id_col, text_col, n, min_words))
    return similar_sets(sets, num, den)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar stems, copies included: the fixed form of this problem's result."""
    members, similar = near_duplicates(table(spark, sf_dir, "questoes"), "id", "enunciado")
    similar = materialize(similar)
    m = members.select("id", "rep")
    across = similar.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select("x", "y")
    copies = members.where("copies > 1").select("id", "rep")
    within = salted_join(copies.toDF("x", "rep"), copies.toDF("y", "rep"), ["rep"]).where("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("questao_id_a"), F.greatest("x", "y").alias("questao_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stem that has a similar one: its class (smallest id reachable) and number of links."""
    members, similar = near_duplicates(table(spark, sf_dir, "questoes"), "id", "enunciado")
    similar = materialize(similar)
    classes = members.where("id = rep").select("rep", "copies")
    sides = similar.union(similar.select("b", "a")).toDF("rep", "other")
    links = sides.join(classes.toDF("other", "others"), "other").groupBy("rep").agg(F.sum("others").alias("linked"))
    components = connected_components(similar, "a", "b").toDF("rep", "component")
    out = members.join(links, "rep", "left").join(components, "rep", "left")
    return out.where("copies > 1 OR linked IS NOT NULL").select(
        F.col("id").alias("questao_id"),
        F.coalesce("component", "rep").alias("grupo_id"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_ligacoes"),
    )


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

_PAIRS = r"""
w AS (
  SELECT id, regexp_extract_all(lower(enunciado), '[\p{L}\p{N}]+') AS w FROM questoes
), s AS (
  SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS s
  FROM w WHERE len(w) >= 25
), t AS (SELECT id, unnest(s) AS g, len(s) AS n FROM s), p AS (
  SELECT a.id AS questao_id_a, b.id AS questao_id_b FROM t a JOIN t b ON a.g = b.g AND a.id < b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 3 * count(*) >= a.n + b.n
)"""

SQL = {
    "p1_found": f"WITH {_PAIRS} SELECT questao_id_a, questao_id_b FROM p",
    "p1_groups": f"""WITH RECURSIVE {_PAIRS}, e AS (
  SELECT questao_id_a AS u, questao_id_b AS v FROM p UNION ALL SELECT questao_id_b, questao_id_a FROM p
), r AS (SELECT u, u AS c FROM e UNION SELECT e.u, r.c FROM r JOIN e ON e.v = r.u)
SELECT x.u AS questao_id, x.c AS grupo_id, y.n AS n_ligacoes
FROM (SELECT u, least(min(c), u) AS c FROM r GROUP BY u) x JOIN (SELECT u, count(*) AS n FROM e GROUP BY u) y USING (u)""",
}
