"""Mixing sources to target weights by a low-discrepancy schedule (operator 2).

Slot ``t`` of the schedule looks at the point ``frac(t / golden ratio)`` of the
unit interval, which the sources divide by their targets; so every stretch of
the schedule holds each source in nearly its share. Slots are ranked per
source, each source's documents are put in a hashed order and cut into blocks
of equally many words, and the slot of rank r takes block r. A source whose
target is above its size starts over, at most ``max_epochs`` times.

Sources are rows of a table like any other: their ranks, targets, shares of the interval and the
join of points with shares are Spark jobs, so their number has no bound.

Documents are ordered by a hash of the id, the id, the size and a hash of the text (of all columns in
:func:`mixture`), so rows that tie are the same in all that is returned, and reruns agree
however the input is partitioned.

Defined results: null text has no words; null is a source of its own, the last;
a document without words is never taken; rows that repeat are mixed as rows of
their own; an empty table gives no rows; extra columns, whatever their names, are ignored by
:func:`taken` and kept by :func:`mixture`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import join_small
from . import common

GOLDEN = np.uint64(0x9E3779B97F4A7C15)   # 2^64 / golden ratio
#: The interval is divided into so many cells at least, on which points and sources meet.
CELLS = 4096


def targets(sizes: list[int], weights: list[float], max_epochs: float = 3.0) -> list[float]:
    """Shares of all words by weight; none above ``max_epochs`` times its source,
    what is over being shared again among the rest until none is above."""
    size, w = np.array(sizes, float), np.array(weights[:len(sizes)], float)
    most, over = max_epochs * size, np.zeros(len(sizes), bool)
    while True:
        share = (size.sum() - most[over].sum()) * w / max(w[~over].sum(), 1e-300)
        new = over | (share > most)
        if (new == over).all():
            return np.where(over, most, share).tolist()
        over = new


def planned(sources: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``sources (src, size)`` with ``target`` as :func:`targets` has it, and ``quota``, the whole words of it.

    Every step takes one row of sums to the driver; the steps end when no further source is above its bound.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", w).withColumn("_most", F.col("size") * max_epochs)
    total = float(sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    over, n_over = F.lit(False), 0
    while True:
        r = rows.agg(F.count(F.when(over, 1)).alias("n"), F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)).alias("most"),
                     F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)).alias("w")).first()
        share = F.lit(total - float(r["most"])) * F.col("_w") / F.lit(max(r["w"], 1e-300))
        # Shares only grow from step to step, so what is above its bound stays above.
        now = over | (share > F.col("_most"))
        n_now = rows.where(now).count()
        if n_now == r["n"]:
            break
        over = now
    target = F.when(over, F.col("_most").cast("double")).otherwise(share)
    return rows.withColumn("target", target).withColumn(
        "quota", F.least(F.bround("target").cast("long"), F.col("_most"))).drop("_w", "_most")


def count_words(docs: DataFrame, id_col: str, source_col: str, text_col: str, key_col: str | None = None,
                tie_col: str | None = None) -> DataFrame:
    """``doc_id, source, size, tie, key``: words are runs of anything but ASCII white space; ``tie`` is a hash
    that orders rows of one id and size."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = common.text_bytes(b.column(2))
            n = np.zeros(len(b), np.int64)
            for i, j in common.slices(off, 8 << 20):
                buf, rel = data[off[i]:off[j]], off[i:j] - off[i]
                inside = common.NOT_SPACE[buf]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                at = rel[rel < len(buf)]
                first[at] = inside[at]
                total = np.concatenate([[0], np.cumsum(first)])
                n[i:j] = np.diff(total[off[i:j + 1] - off[i]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), b.column(3), b.column(4)],
                                             ["doc_id", "source", "size", "tie", "key"])

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.col(text_col).alias("text"), F.col(tie_col) if tie_col else F.xxhash64(F.col(text_col)),
                       F.col(key_col) if key_col else F.lit(None).cast("long"))
    return cols.mapInArrow(sizes, "doc_id long, source string, size long, tie long, key long")


def schedule(spark: SparkSession, blocks: list[int], shares: list[float]) -> DataFrame:
    """:func:`slots` of a list of sources: how many blocks each has, and its share of the interval."""
    top = max([*shares, 1e-300])
    rows = [(i, int(b), int(s / top * 2**40)) for i, (b, s) in enumerate(zip(blocks, shares))]
    return slots(spark.createDataFrame(rows, "src long, blocks long, share long"))


def slots(sources: DataFrame) -> DataFrame:
    """``slot, src, block``: which block of which of the ``sources (src, blocks, share)`` each slot takes.

    A source gets as many slots as it has blocks. Blocks for which the points run out (a bounded few per
    source, the discrepancy of the sequence) come last, source by source, each in a slot of its own.
    """
    spark, chunk = sources.sparkSession, 1 << 16
    placed = common.global_rank(sources.select("src", "blocks", F.when(F.col("blocks") > 0, F.col("share")).otherwise(0).alias("share")),
                                ["src"], "_r", "op2-shares", "share", "lo").drop("_r")
    r = placed.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n"), F.coalesce(F.sum("share"), F.lit(0)).alias("q"),
                   F.count(F.lit(1)).alias("sources")).first()
    n, whole = r["n"], r["q"]
    cell = max(1, -(-whole // max(CELLS, r["sources"])))

    @F.pandas_udf("long")
    def point(t: pd.Series) -> pd.Series:
        u = (t.to_numpy().astype(np.uint64) + np.uint64(1)) * GOLDEN
        return pd.Series(np.minimum(((u >> np.uint64(11)).astype(float) / 2.0**53 * whole).astype(np.int64), max(whole - 1, 0)))

    points = (spark.range(n).select(F.col("id").alias("slot"), point("id").alias("_x"))
              .withColumn("_cell", F.expr(f"_x div {cell}")))
    spans = common.stage(
        placed.where("share > 0").select("src", "lo", (F.col("lo") + F.col("share")).alias("hi")).withColumn(
            "_cell", F.explode(F.expr(f"sequence(lo div {cell}, (hi - 1) div {cell})"))), "op2-spans")
    picks = common.stage(points.join(spans, "_cell").where("_x >= lo and _x < hi").select(
        "slot", "src", F.expr(f"slot div {chunk}").alias("chunk")), "op2-slots")
    held = picks.groupBy("chunk", "src").agg(F.count(F.lit(1)).alias("n"))
    ranked = held.withColumn("n0", F.expr(
        "coalesce(sum(n) over (partition by src order by chunk rows between unbounded preceding and 1 preceding), 0)"))
    rows = (picks.withColumn("k", F.expr("row_number() over (partition by chunk, src order by slot) - 1"))
            .join(ranked.select("chunk", "src", "n0"), ["chunk", "src"])
            .select("slot", "src", (F.col("k") + F.col("n0")).alias("block")))
    need = common.stage(placed.select("src", F.col("blocks").alias("need")).join(
        held.groupBy("src").agg(F.sum("n").alias("given")), "src", "left").select("src", "need", F.coalesce("given", F.lit(0)).alias("given")),
        "op2-need")
    left = common.global_rank(need.where("need > given").withColumn("_left", F.col("need") - F.col("given")), ["src"], "_r",
                              "op2-left", "_left", "_at")
    tail = (left.select("src", "given", "_at", F.explode(F.sequence("given", F.col("need") - 1)).alias("block"))
            .select((F.lit(n) + F.col("_at") + F.col("block") - F.col("given")).alias("slot"), "src", "block"))
    return rows.join(need, "src").where("block < need").select("slot", "src", "block").unionByName(tail)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3,
        block_words: int = 4096, seed: int = 17, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", key_col: str | None = None, tie_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs``: its documents and its pieces.

    Documents: ``row, key, doc_id, source, size, source_size, target``. Pieces:
    ``row, slot, epoch, from_word, words``: the words of that document which the
    block in that slot holds. Sources by code point (null last) take ``weights``
    in turn. ``key_col`` is carried along; ``tie_col`` (default: a hash of the text) orders rows of one id and size.
    """
    sized = common.stage(count_words(docs, id_col, source_col, text_col, key_col, tie_col)
                         .withColumn("last", F.col("source").isNull()), "op2-sizes")
    per = sized.groupBy("last", "source").agg(F.sum("size").alias("size"))
    ranked = common.global_rank(per, ["last", "source"], "src", "op2-sources", "size", "base")
    src = common.stage(planned(common.stage(ranked, "op2-ranked"), weights, max_epochs)
                       .withColumn("blocks", F.expr(f"(quota + {block_words - 1}) div {block_words}"))
                       .withColumnRenamed("size", "source_size"), "op2-targets")
    placed = common.global_rank(sized.withColumn("_k", F.xxhash64("doc_id", F.lit(seed))),
                                ["last", "source", "_k", "doc_id", "size", "tie"], "row", "op2-order", "size", "_before")
    placed = (join_small(placed, src.drop("last"), "source").drop("_k", "last", "tie")
              .withColumn("a", F.col("_before") - F.col("base")))
    documents = placed.select("row", "key", "doc_id", "source", "size", "source_size", "target")
    epochs = (placed.where("size > 0 and quota > 0")
              .withColumn("epoch", F.explode(F.expr("sequence(0L, (quota - 1) div source_size)")))
              .withColumn("lo", F.expr("a + epoch * source_size"))
              .withColumn("hi", F.expr("least(lo + size, quota)")).where("lo < hi"))
    pieces = (epochs.withColumn("block", F.explode(F.expr(
        f"sequence(lo div {block_words}, (hi - 1) div {block_words})")))
        .withColumn("p", F.expr(f"greatest(lo, block * {block_words})"))
        .withColumn("q", F.expr(f"least(hi, (block + 1) * {block_words})"))
        .select("row", "src", "block", "epoch", (F.col("p") - F.col("lo")).alias("from_word"),
                (F.col("q") - F.col("p")).alias("words")))
    chosen = slots(src.select("src", "blocks", F.col("quota").alias("share")))
    return documents, pieces.join(chosen, ["src", "block"]).select("row", "slot", "epoch", "from_word", "words")


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: what the mix takes of it."""
    documents, pieces = mix(docs, **options)
    got = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return (documents.join(got, "row", "left")
            .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("row"))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as the mix takes its words, to the
    nearest whole time (a source's last, cut document rounds up or down); columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, names))
    base = common.stage(docs.toDF(*names).withColumn("key", F.monotonically_increasing_id())
                        .withColumn("tie", F.xxhash64(*common.hashable(docs.toDF(*names)))), "op2-base")
    got = taken(base, id_col=name[id_col], source_col=name[source_col], text_col=name[text_col], key_col="key", tie_col="tie", **options)
    times = (got.where("size > 0").select("key", F.expr("(2 * taken + size) div (2 * size)").alias("times"))
             .where("times > 0"))
    return (base.join(times, "key").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
            .select(*names).toDF(*docs.columns))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by weights 5, 2, 1, at most three epochs of a source."""
    return taken(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "first_slot")
