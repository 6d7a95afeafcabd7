"""Registered corpus queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources import sinks, stages
from ..sources.tables import dirty, read_shards

# Parameters of the registered queries. Shards in the test tables hold 10 to
# 500 documents, so batches of 10 rows give every shard several batches.
QUERY_BATCH_ROWS = 10
QUERY_TARGET_BYTES = 1 << 20     # 1 MiB size target for the cut-off query


def dirty_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(read_shards(spark, sf_dir))


def q_clean_text(spark, sf_dir):
    d = dirty_shards(spark, sf_dir)
    from ..functions.text import clean_text
    c = clean_text("text")
    return d.select("doc_id", F.length(c).cast("bigint").alias("clean_chars"),
                    F.md5(c).alias("clean_md5"))


def q_short_line_ratio(spark, sf_dir):
    lab = C.label_documents(dirty_shards(spark, sf_dir))
    return lab.select("doc_id", "n_lines", "n_short",
                      F.round(F.when(F.col("n_lines") > 0, F.col("n_short") / F.col("n_lines")), 6)
                      .alias("short_ratio"))


def q_corpus_filter(spark, sf_dir):
    lab = C.label_documents(dirty_shards(spark, sf_dir))
    return lab.where(F.col("label") != "empty").select("doc_id", "lang", "n_chars", "label")


def q_corpus_summary(spark, sf_dir):
    return C.corpus_summary(C.label_documents(dirty_shards(spark, sf_dir)))


def q_shard_inventory(spark, sf_dir):
    keys = C.batch_numbers(read_shards(spark, sf_dir).select("shard", "doc_id"), QUERY_BATCH_ROWS)
    return keys.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("batch_id").alias("n_batches"),
        F.min("doc_id").alias("first_doc_id"),
        F.max("doc_id").alias("last_doc_id"))


def _built(spark, sf_dir, target=None):
    return C.build_corpus(dirty_shards(spark, sf_dir), batch_rows=QUERY_BATCH_ROWS,
                          target_bytes=target)


def q_corpus_offsets(spark, sf_dir):
    return _built(spark, sf_dir)["offsets"].select(
        "doc_id", "shard", "batch_id", "n_bytes", "start_byte")


def q_corpus_cutoff(spark, sf_dir):
    b = _built(spark, sf_dir, QUERY_TARGET_BYTES)["batches"]
    return b.select("shard", "batch_id", "n_rows", "kept", "batch_bytes", "bytes_before",
                    "processed")


def shard_folders(spark, sf_dir) -> str:
    """The dirtied shards as a folder each, stored."""
    path = stages.stage_path(spark, "shards", stages.fingerprint(spark, sf_dir, "documents"))
    return stages.stored(spark, path, lambda p: sinks.write_shards(dirty_shards(spark, sf_dir), p))


def q_corpus_until(spark, sf_dir):
    """Batches up to the size target, read shard group by shard group until it is reached."""
    path = shard_folders(spark, sf_dir)
    numbers = [r["shard"] for r in sinks.read_shard_folders(spark, path).select("shard").distinct().orderBy("shard").collect()]
    batches, _ = C.read_until(lambda some: sinks.read_shard_folders(spark, path, some), numbers, QUERY_TARGET_BYTES, QUERY_BATCH_ROWS)
    return batches.select("shard", "batch_id", "n_rows", "kept", "batch_bytes", "bytes_before")


def q_train_val_split(spark, sf_dir):
    o = _built(spark, sf_dir)["offsets"]
    return o.select("doc_id", "start_byte", "n_bytes", "split")


def q_corpus_docs(spark, sf_dir):
    c = _built(spark, sf_dir)["corpus"]
    return c.select("doc_id", "title", "n_chars", "n_bytes", F.md5("doc").alias("doc_md5"))


QUERIES = {
    "clean_text": q_clean_text,
    "short_line_ratio": q_short_line_ratio,
    "corpus_filter": q_corpus_filter,
    "corpus_summary": q_corpus_summary,
    "shard_inventory": q_shard_inventory,
    "corpus_offsets": q_corpus_offsets,
    "corpus_cutoff": q_corpus_cutoff,
    "corpus_until": q_corpus_until,
    "train_val_split": q_train_val_split,
    "corpus_docs": q_corpus_docs,
}
