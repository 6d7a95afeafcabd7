"""Writers and readers of the stage outputs: corpus, merges and vocabulary,
token tables, run history, tokenizer statistics and the study.

Each stage writes Parquet (JSON where the reference's consumers read JSON)
partitioned by the columns later stages filter on, through Spark's file
committer, which gives the all-or-nothing publish the reference gets from a
temporary name and a rename. A write replaces what it writes; a finished stage
is reused by reading it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..session import join_small

HISTORY_SCHEMA = Ty.StructType([
    Ty.StructField("step", Ty.IntegerType()),
    Ty.StructField("train", Ty.DoubleType()),
    Ty.StructField("val", Ty.DoubleType()),
    Ty.StructField("elapsed", Ty.DoubleType()),
    Ty.StructField("appended", Ty.LongType()),
    Ty.StructField("place", Ty.LongType()),
])

STATS_SCHEMA = Ty.StructType([
    Ty.StructField("vocab_size", Ty.IntegerType()),
    Ty.StructField("fertility", Ty.DoubleType()),
    Ty.StructField("tokens_per_compound", Ty.DoubleType()),
    Ty.StructField("german_words_per_256_tokens", Ty.DoubleType()),
    Ty.StructField("compound_splits", Ty.MapType(Ty.StringType(), Ty.ArrayType(Ty.StringType()))),
])


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Corpus rows partitioned by split; order is kept as ``start_byte``. Returns what was stored."""
    corpus.write.mode(mode).partitionBy("split").parquet(path)
    return corpus.sparkSession.read.parquet(path)


def write_shards(shards: DataFrame, path: str) -> None:
    """Shard rows (``shard, doc_id, title, text, lang``), a folder per shard, so that a reader opens the shards it wants."""
    shards.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard_folders(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """Rows of some shards (or all) as :func:`write_shards` stored them; the other folders are not listed."""
    reader = spark.read.option("basePath", path)
    return reader.parquet(path) if shards is None else reader.parquet(*[f"{path}/shard={s}" for s in shards])


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Token tables partitioned by vocabulary and split (ids as ``array<int>``).

    Replaces the vocabularies and splits that ``tokens`` holds and no others.
    """
    (tokens.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("vocab", "split").parquet(path))


def read_tokens(spark: SparkSession, path: str, vocab: int, split: str | None = None) -> DataFrame:
    """One vocabulary (and split); the filters prune partitions."""
    t = spark.read.parquet(path).where(F.col("vocab") == vocab)
    return t if split is None else t.where(F.col("split") == split)


def write_tokenizer(merges: DataFrame, types: DataFrame, path: str) -> None:
    """A learned tokenizer: its merge list and the segmentation of the pieces it was learned on."""
    merges.write.mode("overwrite").parquet(f"{path}/merges")
    types.write.mode("overwrite").parquet(f"{path}/types")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``merges, types`` as stored by :func:`write_tokenizer`."""
    return spark.read.parquet(f"{path}/merges"), spark.read.parquet(f"{path}/types")


def append_history(rows: DataFrame, path: str, order_col: str = "step") -> None:
    """Append evaluation rows (``step, train, val, elapsed``) as JSON lines, with the
    time of the append and each row's place in it: file names do not keep an order."""
    cols = [f.name for f in HISTORY_SCHEMA][:4]
    (rows.select(*cols, F.lit(time.time_ns()).alias("appended"))
     .orderBy(order_col).withColumn("place", F.monotonically_increasing_id()).write.mode("append").json(path))


def read_history(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Run history with a fixed schema, in append order by ``(appended, place)``."""
    h = spark.read.schema(HISTORY_SCHEMA).json(path)
    return h if run_id is None else h.withColumn("run_id", F.lit(run_id))


def resumed_history(history: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """History of runs that were resumed: of a step logged more than once the last
    append counts, and ``elapsed``, which starts anew in each session, continues.

    A session is one append whose ``elapsed`` starts below the end of the one before it.
    """
    keys = list(keys)
    last = history.groupBy(*keys, "step").agg(
        F.max_by(F.struct("train", "val", "elapsed", "appended", "place"), F.struct("appended", "place")).alias("r"))
    rows = last.select(*keys, "step", "r.*")
    # One row per append: sessions follow each other by the time of their append.
    ends = rows.groupBy(*keys, "appended").agg(F.min("elapsed").alias("_lo"), F.max("elapsed").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("appended")
    ends = ends.withColumn("_prev", F.lag("_hi").over(w)).withColumn(
        "_restart", F.when(F.col("_lo") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0)))
    ends = ends.withColumn("_shift", F.sum("_restart").over(w))
    return (join_small(rows, ends.select(*keys, "appended", "_shift"), [*keys, "appended"])
            .withColumn("elapsed", F.col("elapsed") + F.col("_shift")).drop("_shift"))


def write_configs(configs: DataFrame, path: str) -> None:
    """Model configurations as a JSON array, as :func:`~tokloom.operators.study.read_configs` reads them (a handful of rows)."""
    configs.agg(F.to_json(F.collect_list(F.struct(*configs.columns))).alias("value")).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tokenizer statistics as JSON (nested map of splits; non-ASCII kept)."""
    stats.write.mode(mode).json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).json(path)


def write_study(study: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Study rows as JSON, one file; returns them as read back."""
    study.coalesce(1).write.mode(mode).json(path)
    return study.sparkSession.read.schema(study.schema).json(path)
