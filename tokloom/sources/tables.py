"""Readers for the input tables and the views derived from them.

Each reader selects only the columns its callers use, so the Parquet scan reads
a pruned schema.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import rank_within
from ..session import join_small

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; a missing path raises an analysis error."""
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition when the scan yields fewer tasks than cores.

    A single-row-group file is read by one task; text work after it would run
    on one core. Large inputs (many files or row groups) are left as they are.
    """
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


#: Sources that are not numbered follow the numbered ones, from this shard number on.
OTHER_SHARDS = 1_000_000_000


def source_number(source: str | Column) -> Column:
    """The number in ``src<number>``; null for any other source."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(s.rlike(r"\Asrc(0|[1-9][0-9]{0,8})\z"), F.try_to_number(F.substring(s, 4, 9), F.lit("999999999")).cast("int"))


def as_shards(docs: DataFrame) -> DataFrame:
    """``shard, doc_id, title, text, lang`` of documents with any sources.

    ``shard`` is the number in a numbered source (``src7`` -> 7); the other sources
    follow in code point order, null last, one number each. The corpus order is
    ``(shard, doc_id)``; ``title`` is ``source/doc_id``.
    """
    shard = source_number("source")
    other = docs.where(shard.isNull()).select("source")
    rows = docs
    if other.take(1):
        named = rank_within(other.distinct().withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
        rows = join_small(docs, named.select("source", (F.col("_rank") - 1 + OTHER_SHARDS).cast("int").alias("_rank")), "source", "left")
        shard = F.coalesce(shard, F.col("_rank"))
    return rows.select(shard.alias("shard"), "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("title"),
                       "text", "lang")


def shard_numbers(sources: DataFrame) -> DataFrame:
    """``source, shard`` of every distinct source, numbered as by :func:`as_shards`."""
    rows = sources.select("source").distinct().withColumn("_n", source_number("source"))
    other = rows.where(F.col("_n").isNull()).withColumn("_null", F.col("source").isNull())
    named = rank_within(other, [], ["_null", "source"], "_rank").select("source", (F.col("_rank") - 1 + OTHER_SHARDS).cast("int").alias("shard"))
    return rows.where(F.col("_n").isNotNull()).select("source", F.col("_n").alias("shard")).unionByName(named)


def read_shards(spark: SparkSession, sf_dir: str, langs: list[str] | None = None) -> DataFrame:
    """The documents table as shard rows (:func:`as_shards`), of some languages or all."""
    d = read_table(spark, sf_dir, "documents")
    if langs:
        d = d.where(F.col("lang").isin(list(langs)))
    return as_shards(spread(d))


def dirty(df: DataFrame, text_col: str = "text", key_col: str = "doc_id") -> DataFrame:
    """Deterministically dirtied text, so that cleaning is not tested as a no-op.

    key % 4 = 0: each space -> TAB, space, NBSP; 1: each LF -> CR LF;
    2: each LF -> four LF; 3: two spaces before, LF and space after.
    """
    t, k = F.col(text_col), F.col(key_col) % 4
    out = (F.when(k == 0, F.regexp_replace(t, " ", "\t \u00a0"))
           .when(k == 1, F.regexp_replace(t, "\n", "\r\n"))
           .when(k == 2, F.regexp_replace(t, "\n", "\n\n\n\n"))
           .otherwise(F.concat(F.lit("  "), t, F.lit("\n "))))
    return df.withColumn(text_col, out)
