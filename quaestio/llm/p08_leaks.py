"""Problem 8: passages of evaluation items inside documents.

Texts become sequences of word hashes (case, accents and signs ignored). Every window of ``WINDOW``
words, of items and of documents, goes through CGK random-walk embeddings: a walk reads the window
and stays on or leaves each word by a random bit of that word and step, which maps edit distance to
Hamming distance. Each repetition samples positions of its walk into one hash (bit-sampling LSH);
windows of equal hash are candidates, and each candidate is verified by its exact edit distance in
words. Equal windows have equal walks, so unedited passages are found with certainty; windows with
edits are found with a probability that repetitions raise.

Items are the stated query set: they are broadcast in blocks of at most ``ITEM_BLOCK`` items, and
each block passes over all documents, which are never shuffled. Result rows are one a (document, item).

Defined cases: null, empty and short texts match nothing; repeated items or documents give a row each;
empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestio.session import spread, table

WINDOW = 12  # words: the shortest passage to report
STEPS = 3 * WINDOW  # length of a walk
SAMPLED = 7  # positions of a walk in one hash
MAX_EDITS = 2  # words by which a window may differ in ``p8_edited``
RECALL = 0.9  # of single windows with ``MAX_EDITS`` edits, the least that ``p8_edited`` is to find
#: The chance that one repetition joins two windows with two changed words. Measured over every pair of places (3,000 windows each,
#: 40 repetitions), the least is 0.15 and the mean 0.20; it is taken lower, as the few repetitions used may be worse than their mean.
MEETS = 0.14
REPETITIONS = math.ceil(math.log(1 - RECALL) / math.log(1 - MEETS))
ITEM_BLOCK = 20_000
SEED = 20_240_801
#: Combining marks of the first plane; a class of these alone is matched by table, so the rare others go one by one.
_MARKS = re.compile("[" + "".join(chr(o) for o in range(0x300, 0x10000) if unicodedata.combining(chr(o))) + "]+")
_WORD = re.compile(r"[^\W_]+")


def word_hashes(text: str | None, cache: dict) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    plain = text.lower()
    if not plain.isascii():
        plain = _MARKS.sub("", unicodedata.normalize("NFD", plain))
        if max(plain, default="") > "\uffff":
            plain = "".join(c for c in plain if not unicodedata.combining(c))
    out = []
    for w in _WORD.findall(plain):
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w) >> 1 | 1
        out.append(h)
    return np.array(out, np.int64)


def _plan(repetition: int):
    rng = np.random.default_rng([SEED, repetition])
    odd = rng.integers(1, 1 << 62, STEPS, dtype=np.int64) * 2 + 1
    at = np.sort(rng.choice(STEPS, SAMPLED, replace=False))
    return odd, set(at.tolist()), int(at[-1])


def walk_hashes(words: np.ndarray, starts: np.ndarray, repetition: int) -> np.ndarray:
    """One LSH hash of each window words[start : start + WINDOW]."""
    odd, sampled, last = _plan(repetition)
    at = np.zeros(len(starts), np.int64)
    out = np.full(len(starts), repetition, np.int64)
    with np.errstate(over="ignore"):
        for t in range(last + 1):
            inside = at < WINDOW
            symbol = np.where(inside, words[starts + np.minimum(at, WINDOW - 1)], 0)
            if t in sampled:
                out = (out ^ symbol) * np.int64(-7046029254386353131)
                out ^= (out >> 29) & 0x7FFFFFFFF
            mixed = symbol * odd[t]
            at += ((mixed ^ (mixed >> 31)) * np.int64(0x165667B19E3779F9) < 0) & inside
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance in words of row pairs of two (n, WINDOW) arrays."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1, dtype=np.int16), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(w):
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + (a[:, i] != b[:, j]))
        row = new
    return row[:, w]


def contents(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit digest of the words of each window, whatever their place."""
    out = np.full(len(starts), SEED, np.int64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out = (out ^ words[starts + k]) * np.int64(-7046029254386353131)
            out ^= (out >> 29) & 0x7FFFFFFFF
    return out


class ItemIndex:
    """The distinct windows of all items, with the items that hold each, under their hashes."""

    def __init__(self, items: list[tuple[int, str]], repetitions: int = REPETITIONS):
        cache: dict = {}
        seqs = [(i, word_hashes(t, cache)) for i, t in items]
        seqs = [(i, h) for i, h in seqs if len(h) >= WINDOW]
        counts = [len(h) - WINDOW + 1 for _, h in seqs]
        item = np.repeat(np.array([i for i, _ in seqs], np.int64), counts)
        windows = [np.lib.stride_tricks.sliding_window_view(h, WINDOW) for _, h in seqs]
        words = np.concatenate(windows) if seqs else np.zeros((0, WINDOW), np.int64)
        digest = contents(words.ravel(), np.arange(len(words)) * WINDOW) if len(words) else np.zeros(0, np.int64)
        _, first, which = np.unique(digest, return_index=True, return_inverse=True)
        self.words = words[first]
        held = np.unique(np.stack([which, item], 1), axis=0) if len(words) else np.zeros((0, 2), np.int64)
        self.items = held[:, 1]
        self.at = np.searchsorted(held[:, 0], np.arange(len(first) + 1))
        self.sorted = []
        flat = self.words.ravel()
        for r in range(repetitions):
            h = walk_hashes(flat, np.arange(len(self.words)) * WINDOW, r) if len(flat) else np.zeros(0, np.int64)
            order = np.argsort(h, kind="stable")
            self.sorted.append((h[order], order))

    def holders(self, k: int) -> np.ndarray:
        return self.items[self.at[k] : self.at[k + 1]]

    def candidates(self, words: np.ndarray, starts: np.ndarray, repetition: int):
        """(window, item window) of equal hash."""
        keys, order = self.sorted[repetition]
        h = walk_hashes(words, starts, repetition)
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        n = hi - lo
        hit = np.flatnonzero(n)
        n = n[hit]
        left = np.repeat(hit, n)
        at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return left, order[at]


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edicoes", pa.int32()), ("palavras_seguidas", pa.int32()), ("janelas", pa.int32())])
PIECE = 200_000  # windows at once


def _scan(shared, max_edits: int):
    def run(batches):
        index: ItemIndex = shared.value
        cache: dict = {}
        for batch in batches:
            docs, seqs = [], []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = word_hashes(text.as_py(), cache)
                if doc is not None and len(h) >= WINDOW:
                    docs.append(doc)
                    seqs.append(h)
                    size += len(h)
                if size >= PIECE:
                    yield _match(index, docs, seqs, max_edits)
                    docs, seqs, size = [], [], 0
            if docs:
                yield _match(index, docs, seqs, max_edits)

    return run


def _match(index: ItemIndex, docs: list, seqs: list, max_edits: int) -> pa.RecordBatch:
    words = np.concatenate(seqs)
    lens = np.array([len(s) for s in seqs])
    owner = np.repeat(np.arange(len(seqs)), lens)
    left_over = np.repeat(np.cumsum(lens), lens) - np.arange(len(words))
    places = np.flatnonzero(left_over >= WINDOW)
    # repeated windows are searched once
    _, first, which = np.unique(contents(words, places), return_index=True, return_inverse=True)
    starts = places[first]
    found = []
    for r in range(len(index.sorted)):
        w, k = index.candidates(words, starts, r)
        if len(w):
            d = (words[starts[w][:, None] + np.arange(WINDOW)] != index.words[k]).any(1).astype(np.int16)
            if max_edits:
                other = np.flatnonzero(d)
                d[other] = edit_distances(words[starts[w[other]][:, None] + np.arange(WINDOW)], index.words[k[other]])
            ok = d <= max_edits
            found.append(np.stack([w[ok], k[ok], d[ok]], 1))
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    met: dict[int, list[tuple[int, int]]] = {}
    for w, k, d in rows.tolist():
        met.setdefault(w, []).append((k, d))
    hit = np.zeros(len(starts), bool)
    hit[list(met)] = True
    at = np.flatnonzero(hit[which])
    out: list[tuple] = []
    for group in np.split(at, np.flatnonzero(np.diff(owner[places[at]])) + 1) if len(at) else []:
        out += _of_document(index, docs[owner[places[group[0]]]], places[group], which[group], met)
    cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, OUT, strict=True)], schema=OUT)


def _of_document(index: ItemIndex, doc: int, places: np.ndarray, which: np.ndarray, met: dict) -> list[tuple]:
    """(doc, item, least distance, longest run, windows) for each item met in one document."""
    order = np.argsort(which, kind="stable")
    kinds, cut = np.unique(which[order], return_index=True)
    of_kind = dict(zip(kinds.tolist(), np.split(places[order], cut[1:]), strict=True))
    parts: dict[int, list[tuple[int, int]]] = {}
    for u in of_kind:
        for k, d in met[u]:
            for item in index.holders(k).tolist():
                parts.setdefault(item, []).append((d, u))
    rows = []
    for item, met_kinds in parts.items():
        exact = {u for d, u in met_kinds if d == 0}
        run = 0
        if exact:
            p = np.sort(np.concatenate([of_kind[u] for u in exact]))
            breaks = np.flatnonzero(np.diff(p) != 1)
            run = int(np.diff(np.concatenate(([-1], breaks, [len(p) - 1]))).max()) + WINDOW - 1
        windows = sum(len(of_kind[u]) for u in {u for _, u in met_kinds})
        rows.append((doc, item, min(d for d, _ in met_kinds), run, windows))
    return rows


def leaked(documents: DataFrame, items: DataFrame, max_edits: int = 0, repetitions: int | None = None) -> DataFrame:
    """(doc_id, item_id, edicoes, palavras_seguidas, janelas): the least edit distance of a window pair,
    the longest stretch of the document whose windows all occur in the item (0 if all are edited), in words,
    and the number of windows of the document that match."""
    if repetitions is None:  # equal windows meet in any one repetition
        repetitions = REPETITIONS if max_edits else 1
    spark = documents.sparkSession
    docs = spread(documents.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL"))
    rows = items.where("texto IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "texto")
    blocks = max(1, -(-rows.count() // ITEM_BLOCK))
    parts = []
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in block.collect()], repetitions))
        parts.append(docs.mapInArrow(_scan(index, max_edits), "doc_id long, item_id long, edicoes int, palavras_seguidas int, janelas int"))
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) with at least ``WINDOW`` words in a row in common."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "itens_avaliacao")).select("doc_id", "item_id")


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p8_found``, with windows of up to ``MAX_EDITS`` edited words, and the extent of each leak."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "itens_avaliacao"), MAX_EDITS)


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item, the number of documents that hold it and its longest passage there."""
    return p8_report(leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "itens_avaliacao")))


def p8_report(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id").agg(F.count("*").alias("n_documentos"), F.max("palavras_seguidas").cast("int").alias("maior_trecho"))


QUERIES = {"p8_found": p8_found, "p8_edited": p8_edited, "p8_items": p8_items}

_W = f"""
d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(texto)), '[\\p{{L}}\\p{{N}}]+') AS w FROM itens_avaliacao),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) AS g FROM d),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda k: array_to_string(w[k:k + {WINDOW - 1}], ' '))) AS g FROM i)"""

SQL = {
    "p8_found": f"WITH {_W} SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)",
    "p8_items": f"""WITH {_W}, p AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS k, w FROM d), m AS (SELECT DISTINCT doc_id, item_id, k FROM (SELECT doc_id, k, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g FROM p) JOIN iw USING (g)),
r AS (SELECT doc_id, item_id, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS corrida FROM m), t AS (SELECT doc_id, item_id, corrida, count(*) + {WINDOW - 1} AS n FROM r GROUP BY ALL)
SELECT item_id, count(DISTINCT doc_id) AS n_documentos, max(n)::INTEGER AS maior_trecho FROM t GROUP BY 1""",
}
