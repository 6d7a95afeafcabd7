"""Ranked lexical search by dense blocked matrix products (operator 12).

Items are taken in blocks of bounded size. A block's distinct terms are its compact
vocabulary, cut into tiles of ``VOCABULARY_TILE`` terms; documents come in tiles of
``DOCUMENT_TILE``. Per pair of tiles the document impacts (integers) form a dense
float64 matrix, the item weights another, and BLAS multiplies them: a weight is below
2^16 and an impact below 2^20, so the sums over a tile of 2^12 terms stay below 2^48, and
every partial sum is an integer that float64 holds exactly, in whatever order it is added.
Tiles are added up in 64-bit integers. Per document tile and item the rows at or above the k-th
score are kept, ties included, and cut by (score, doc_id); what leaves a task is at most
k rows per item, of which Spark takes the best k again.

A first pass over the texts stages per document the number of its terms and the counts of
the block's terms; document frequencies, the number of documents and of terms are sums over all of them.

Defined results: null text and a text without terms are not counted and never ranked; an item without terms
has no rows; rows of the item table that repeat are items of their own; equal scores go by
ascending doc_id, null ids last; a document whose row repeats is ranked as often as it is there;
empty tables give no rows; columns beyond id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY_TILE = 1 << 12
DOCUMENT_TILE = 1 << 8
ITEM_TILE = 1 << 10
#: Weight tiles (32 MB at most) that a task keeps; the others are filled anew when they are needed.
KEPT_TILES = 4
#: Bytes of item text from which a new block of items begins (a block is read by every task).
BLOCK_BYTES = 8 << 20
LIMIT = 2**63 - 1


def item_blocks(items: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item, block, item_id, text``: items numbered in order of id and text, and the block of each.

    A block has at most ``block_bytes`` of text and one item more.
    """
    rows = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text").cast("long") + 64)
    ranked = common.global_rank(rows, ["item_id", "text"], "item", "op12-items", "size", "before")
    return ranked.select("item", F.expr(f"before div {int(block_bytes)}").alias("block"), "item_id", "text")


def block_terms(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary of some texts, and their distinct terms as pairs ``text, term``."""
    off, data = common.text_bytes(pa.array(texts, pa.large_string()))
    w = common.cut_words(off, data, 0, len(texts))
    coded = common.word_strings(w, common.ALNUM).dictionary_encode()
    pairs = np.unique(np.stack([w.doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)], 1), axis=0)
    return coded.dictionary, pairs[:, 0], pairs[:, 1]


def count_terms(docs: DataFrame, vocabulary: pa.Array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, term, tf``: how many terms a document has, and the counts of those in the vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            off, data = common.text_bytes(b.column(1))
            for i, j in common.slices(off):
                w = common.cut_words(off, data, i, j)
                n = w.per_doc().astype(np.int64)
                at = pc.index_in(common.word_strings(w, common.ALNUM), value_set=known)
                ok = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                term = at.take(pa.array(ok)).to_numpy(zero_copy_only=False).astype(np.int64)
                key, tf = np.unique(w.doc[ok] * len(known) + term, return_counts=True)
                ends = np.searchsorted(key, np.arange(j - i + 1) * max(1, len(known))).astype(np.int32)
                term = pa.array((key % max(1, len(known))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), term),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))], ["doc_id", "n", "term", "tf"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>"))


def frequencies(counted: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and per term the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            n = np.asarray(b.column(0))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            df += np.bincount(np.asarray(b.column(1).flatten()), minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, n_terms)), pa.array(np.concatenate([[docs, terms], df]))], ["t", "v"])

    out = np.zeros(n_terms + 2, np.int64)
    for r in counted.select("n", "term").mapInArrow(run, "t long, v long").groupBy("t").agg(F.sum("v").alias("v")).collect():
        out[r["t"] + 2] = r["v"]
    return int(out[0]), int(out[1]), out[2:]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Integer impact of ``tf`` occurrences in documents of ``n`` terms."""
    if len(n) and 90 * int(n.max()) * n_docs > LIMIT:
        share = np.array([90 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        share = 90 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + share))


def best(scores: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Rows of the ``k`` best scores above 0, best first; equal ones by id, null last."""
    rows = np.flatnonzero(scores > 0)
    if len(rows) > k:
        least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
        rows = rows[scores[rows] >= least]              # all that tie with the k-th
    return rows[np.lexsort((doc[rows], null[rows], -scores[rows]))[:k]]


def scored(counted: DataFrame, item: np.ndarray, term: np.ndarray, w: np.ndarray, n_items: int, n_docs: int, n_terms: int,
           k: int) -> DataFrame:
    """``item, doc_id, score``: at most ``k`` rows per item and task."""
    held = counted.sparkSession.sparkContext.broadcast((item, term, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, term, w = held.value
        top = [(np.zeros(0, np.int64),) * 3 for _ in range(n_items)]
        tiles: dict[tuple[int, int], np.ndarray] = {}

        def weight_tile(i0: int, i1: int, v0: int, v1: int) -> np.ndarray:
            left = tiles.get((i0, v0))
            if left is None:
                mine = (term >= v0) & (term < v1) & (item >= i0) & (item < i1)
                left = np.zeros((i1 - i0, v1 - v0))
                left[item[mine] - i0, term[mine] - v0] = w[term[mine]]
                if len(tiles) < KEPT_TILES:
                    tiles[i0, v0] = left
            return left

        for b in batches:
            n, tf = np.asarray(b.column(1)), np.asarray(b.column(3).flatten())
            at = np.asarray(b.column(2).flatten())
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(b.column(2))))])
            doc = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for d0 in range(0, len(b), DOCUMENT_TILE):
                d1 = min(d0 + DOCUMENT_TILE, len(b))
                s = slice(ends[d0], ends[d1])
                row = np.repeat(np.arange(d1 - d0), np.diff(ends[d0:d1 + 1]))
                value = impacts(tf[s], n[d0:d1][row], n_docs, n_terms)
                for i0 in range(0, n_items, ITEM_TILE):
                    i1 = min(i0 + ITEM_TILE, n_items)
                    sums = np.zeros((i1 - i0, d1 - d0), np.int64)
                    for v0 in range(0, len(w), VOCABULARY_TILE):
                        v1 = min(v0 + VOCABULARY_TILE, len(w))
                        here = (at[s] >= v0) & (at[s] < v1)
                        right = np.zeros((v1 - v0, d1 - d0))
                        right[at[s][here] - v0, row[here]] = value[here]
                        sums += (weight_tile(i0, i1, v0, v1) @ right).astype(np.int64)
                    for i in range(i0, i1):
                        old = top[i]
                        sc = sums[i - i0]
                        if len(old[0]) == k:
                            more = np.flatnonzero(sc >= old[0][-1])
                            if not len(more):
                                continue
                        else:
                            more = np.flatnonzero(sc > 0)
                        both = [np.concatenate([o, x]) for o, x in zip(old, (sc[more], doc[d0:d1][more], null[d0:d1][more]))]
                        r = best(*both, k)
                        top[i] = tuple(x[r] for x in both)
        size = np.array([len(t[0]) for t in top])
        if size.sum():
            sc, doc, null = (np.concatenate([t[c] for t in top]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n_items), size)), pa.array(doc, mask=null.astype(bool)),
                                              pa.array(sc)], ["item", "doc_id", "score"])

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item, item_id, rank, doc_id, score``: the ``k`` best documents of every item; ``item`` numbers the item rows."""
    spark = docs.sparkSession
    blocks = common.stage(item_blocks(items, item_col, item_text_col, block_bytes), "op12-blocks")
    n_blocks = (blocks.agg(F.max("block").alias("b")).first()["b"] or 0) + 1
    out = None
    for block in range(n_blocks):
        rows = blocks.where(F.col("block") == block).orderBy("item").collect()
        vocabulary, item, term = block_terms([r["text"] for r in rows])
        counted = common.stage(count_terms(docs, vocabulary, id_col, text_col), "op12-counts")
        n_docs, n_terms, df = frequencies(counted, len(vocabulary))
        part = scored(counted, item, term, weights(n_docs, df), len(rows), n_docs, n_terms, k)
        part = part.withColumn("item", F.col("item") + F.lit(rows[0]["item"] if rows else 0))
        part = common.stage(part, "op12-best") if n_blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(blocks.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, out of all documents."""
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY doc_id, w, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, c GROUP BY t, docs),
im AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS im FROM tf, c),
sc AS (SELECT item_id, doc_id, CAST(sum(wt * im) AS BIGINT) AS score FROM q JOIN wt USING (t) JOIN im USING (t) GROUP BY item_id, doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk WHERE rank <= 10"""
