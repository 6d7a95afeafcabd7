"""Corpus preparation: clean, filter with reasons, count, order, cut, split.

Cleaning and filtering are narrow (map-only) projections over the scan. The
order-dependent parts (batch numbers, byte offsets, the size cut-off and the
positional split) run on a narrow key table ``(row, shard, doc_id, n_bytes,
label)``; the text is joined back once, on ``row``, the number of a row in the
order of the corpus. Ids may repeat or be null: rows are told by ``row`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import BATCH_ROWS, BYTES_PER_TOKEN_ESTIMATE, MIN_CHARS, VAL_FRACTION
from ..session import staged
from .ordering import rank_within, running_sum_before


def label_documents(shards: DataFrame) -> DataFrame:
    """Add ``clean``, ``n_chars``, ``n_lines``, ``n_short`` and ``label``.

    ``label`` is ``empty`` for null or empty text (skipped, never counted),
    ``short`` (fewer than 600 characters after cleaning), else ``list`` (more
    than half the non-blank lines short, or none), else ``kept``. The first
    matching reason wins. Rows keep all input columns.
    """
    d = shards.withColumn("clean", T.clean_text("text"))
    n_lines, n_short = T.line_counts("clean")
    d = (d.withColumn("n_chars", T.char_len("clean").cast("bigint"))
          .withColumn("n_lines", n_lines)
          .withColumn("n_short", n_short))
    label = (F.when(F.col("text").isNull() | (F.col("text") == ""), F.lit("empty"))
             .when(F.col("n_chars") < MIN_CHARS, F.lit("short"))
             .when(~T.is_prose(F.col("n_lines"), F.col("n_short")), F.lit("list"))
             .otherwise(F.lit("kept")))
    return d.withColumn("label", label)


def formatted(labelled: DataFrame) -> DataFrame:
    """Add ``doc`` (formatted article) and ``n_bytes`` (its UTF-8 size, 0 unless kept)."""
    doc = F.when(F.col("label") == "kept", T.format_doc("title", "clean"))
    return (labelled.withColumn("doc", doc)
            .withColumn("n_bytes", F.coalesce(T.utf8_len("doc"), F.lit(0)).cast("bigint")))


def corpus_summary(labelled: DataFrame) -> DataFrame:
    """Counters per shard plus a total row (shard NULL) via ``rollup``.

    ``bytes`` is the size of the formatted kept documents; ``est_mtokens`` the
    rough token estimate in millions (bytes / 3.2).
    """
    f = formatted(labelled)
    agg = (f.rollup("shard").agg(
        F.sum(F.when(F.col("label") == "kept", 1).otherwise(0)).cast("bigint").alias("kept"),
        F.sum(F.when(F.col("label") == "short", 1).otherwise(0)).cast("bigint").alias("skipped_short"),
        F.sum(F.when(F.col("label") == "list", 1).otherwise(0)).cast("bigint").alias("skipped_list"),
        F.sum("n_bytes").cast("bigint").alias("bytes")))
    return agg.withColumn(
        "est_mtokens", F.round(F.col("bytes") / F.lit(BYTES_PER_TOKEN_ESTIMATE) / F.lit(1e6), 6))


def in_order(shards: DataFrame) -> DataFrame:
    """Rows of the corpus by shard, id and a hash of the text, divided by ranges of that order."""
    order = ["shard", "doc_id", F.xxhash64("text")]
    return shards.repartitionByRange(*order).sortWithinPartitions(*order)


def batch_numbers(keys: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Add ``row_in_shard`` (0-based) and ``batch_id`` to a table holding ``shard, doc_id``
    and, where ids may repeat, ``row``.

    The position is a two-level prefix count, so one huge shard is spread over
    as many range partitions as its size needs.
    """
    order = ["doc_id", "row"] if "row" in keys.columns else ["doc_id"]
    ranked = rank_within(keys, ["shard"], order, "row_in_shard")
    return (ranked.withColumn("row_in_shard", F.col("row_in_shard") - 1)
            .withColumn("batch_id", F.floor(F.col("row_in_shard") / F.lit(batch_rows)).cast("bigint")))


def key_table(labelled_fmt: DataFrame) -> DataFrame:
    """Narrow key table over *all* raw rows (batches count every row read)."""
    return labelled_fmt.select("row", "shard", "doc_id", "label", "n_bytes")


def batch_table(keys_b: DataFrame) -> DataFrame:
    """One row per (shard, batch): rows, counters, bytes and bytes written before it."""
    b = keys_b.groupBy("shard", "batch_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("label") == "kept", 1).otherwise(0)).cast("bigint").alias("kept"),
        F.sum(F.when(F.col("label") == "short", 1).otherwise(0)).cast("bigint").alias("skipped_short"),
        F.sum(F.when(F.col("label") == "list", 1).otherwise(0)).cast("bigint").alias("skipped_list"),
        F.sum("n_bytes").cast("bigint").alias("batch_bytes"))
    return running_sum_before(b, ["shard", "batch_id"], "batch_bytes", "bytes_before")


def cutoff_batches(batches: DataFrame, target_bytes: int | None) -> DataFrame:
    """Mark batches processed before the size target stops the run.

    A batch is read when the bytes written before it are below the target (the
    reference checks after every batch and before every shard; both reduce to
    this). ``target_bytes=None`` keeps everything.
    """
    if target_bytes is None:
        return batches.withColumn("processed", F.lit(True))
    return batches.withColumn("processed", F.col("bytes_before") < F.lit(int(target_bytes)))


def doc_offsets(keys_b: DataFrame, batches: DataFrame) -> DataFrame:
    """``start_byte`` of each kept document in corpus order.

    Within a batch the running sum is a window partitioned by (shard, batch):
    at most ``batch_rows`` rows per group.
    """
    w = (Window.partitionBy("shard", "batch_id").orderBy("doc_id", "row")
         .rowsBetween(Window.unboundedPreceding, -1))
    kept = keys_b.where(F.col("label") == "kept")
    within = kept.withColumn("_in_batch", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)))
    b = batches.select("shard", "batch_id", "bytes_before", "processed")
    return (within.join(b, ["shard", "batch_id"])
            .withColumn("start_byte", (F.col("bytes_before") + F.col("_in_batch")).cast("bigint"))
            .drop("_in_batch", "bytes_before"))


def read_until(read: Callable[[list[int]], DataFrame], shards: list[int], target_bytes: int, batch_rows: int = BATCH_ROWS,
               group: int = 1) -> tuple[DataFrame, list[int]]:
    """The size cut-off without reading what comes after it: processed batches, and the shards that were read.

    ``read(numbers)`` gives the rows of some shards. Shards are read in order, in groups that double in size
    from ``group`` on, and the running total is carried from group to group; when it reaches the target, no further
    group is read. So at most the last group is read in vain, and it is no larger than all before it (but for
    the size of its shards). Batches are numbered inside their shard, so groups do not change them.
    """
    total, done, out, at = 0, [], None, 0
    while at < len(shards) and (total < target_bytes or out is None):
        some = shards[at:at + group]
        labelled = staged(formatted(label_documents(in_order(read(some)))).drop("clean", "doc", "text")
                          .withColumn("row", F.monotonically_increasing_id()), "group")
        batches = batch_table(batch_numbers(key_table(labelled), batch_rows))
        batches = staged(cutoff_batches(batches.withColumn("bytes_before", F.col("bytes_before") + F.lit(total)), target_bytes), "batches")
        done += some
        out = batches if out is None else out.unionByName(batches)
        total += batches.agg(F.coalesce(F.sum("batch_bytes"), F.lit(0)).alias("b")).first()["b"]
        at += len(some)
        group *= 2
    if out is None:
        raise ValueError("no shards")
    return out.where("processed").drop("processed"), done


def split_column(offsets: DataFrame, val_fraction: float = VAL_FRACTION) -> DataFrame:
    """Positional split: documents starting before floor(total*(1-f)) are train.

    ``offsets`` holds only processed kept documents; the total is one scalar
    aggregate, planned as a scalar subquery.
    """
    spark = offsets.sparkSession
    with_total = spark.sql(
        "SELECT *, (SELECT coalesce(sum(n_bytes), 0) FROM {o}) AS _total FROM {o}", o=offsets)
    val_start = F.floor(F.col("_total").cast("double") * F.lit(1.0 - val_fraction))
    return (with_total
            .withColumn("split", F.when(F.col("start_byte") < val_start, "train").otherwise("val"))
            .drop("_total"))


def build_corpus(shards: DataFrame, batch_rows: int = BATCH_ROWS,
                 target_bytes: int | None = None,
                 val_fraction: float = VAL_FRACTION) -> dict[str, DataFrame]:
    """Full preparation. Returns ``labelled``, ``batches``, ``offsets`` (narrow,
    with split) and ``corpus`` (text rows).

    ``corpus`` columns: row, shard, doc_id, batch_id, title, doc, n_bytes, n_chars,
    start_byte, split, lang. Texts are cleaned once: what the order is found
    from and what is joined to it read the same stored rows.
    """
    # One copy of the text is stored, the cleaned one of kept documents; their heading is put on again when they are read.
    labelled = staged(formatted(label_documents(in_order(shards))).drop("text", "doc")
                      .withColumn("clean", F.when(F.col("label") == "kept", F.col("clean")))
                      .withColumn("row", F.monotonically_increasing_id()), "labelled")
    keys_b = batch_numbers(key_table(labelled), batch_rows)
    batches = cutoff_batches(batch_table(keys_b), target_bytes)
    offs = doc_offsets(keys_b, batches).where("processed")
    offs = split_column(offs.select("row", "shard", "doc_id", "batch_id", "n_bytes", "start_byte"),
                        val_fraction)
    text = labelled.where(F.col("label") == "kept").select(
        "row", "title", T.format_doc("title", "clean").alias("doc"), "clean", "n_chars", "lang")
    corpus = offs.join(text, "row")
    return {"labelled": labelled, "keys": keys_b, "batches": batches,
            "offsets": offs, "corpus": corpus}
