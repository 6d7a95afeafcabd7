"""A token table that is read by position.

Documents are range-partitioned by their place in the corpus and encoded in that order; every part is
a folder of its own and its rows carry ``local_pos``, the tokens of their vocabulary before them in
the part. The manifest, a row per vocabulary, split and part, says which positions of the vocabulary's
stream a part holds: ``start_pos`` is its base plus ``local_pos``. So a reader of some positions
opens the files of the parts that hold them and lists no others, and nothing is summed
over documents again.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.encode import Merge, encode_texts
from ..operators.windows import sample_windows, window_starts

KEYS = ["doc_id", "split", "start_byte", "n_bytes", "n_doc_chars", "n_words"]


def write_store(corpus: DataFrame, path: str, merges: list[Merge], sizes: Sequence[int], types: DataFrame | None = None,
                parts: int | None = None, derived: dict[str, Column] | None = None) -> None:
    """Encode ``corpus`` (``doc`` and :data:`KEYS`) into a store at ``path``, by each vocabulary in ``sizes``.

    ``derived``: those of the :data:`KEYS` that are found from the others once the rows lie in order, and so only once
    (the ranges are found from a pass over ``corpus`` of its own)."""
    order = corpus.repartitionByRange(parts, "start_byte") if parts else corpus.repartitionByRange("start_byte")
    ordered = order.sortWithinPartitions("start_byte").withColumns(derived or {})
    tokens = encode_texts(ordered, "doc", KEYS, merges, sizes, types=types, positions=True)
    tokens.write.mode("overwrite").partitionBy("vocab", "split", "part").parquet(os.path.join(path, "tokens"))
    stored = corpus.sparkSession.read.parquet(os.path.join(path, "tokens"))
    per = stored.groupBy("vocab", "split", "part").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.min("local_pos").alias("first"),
        F.max(F.col("local_pos") + F.col("n_tokens")).alias("last"))
    # One row per part: the windows go over the parts of one vocabulary.
    whole = per.groupBy("vocab", "part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("vocab").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = whole.select("vocab", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    manifest = per.join(base, ["vocab", "part"]).select(
        F.col("vocab").cast("int").alias("vocab"), "split", F.col("part").cast("int").alias("part"), "n_docs", "n_tokens", "base",
        (F.col("base") + F.col("first")).alias("lo"), (F.col("base") + F.col("last")).alias("hi"))
    manifest.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "manifest"))


class TokenStore:
    """Reads a store written by :func:`write_store`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.manifest = spark.read.parquet(os.path.join(path, "manifest"))

    def tokens(self, vocab: int | None = None, split: str | None = None, parts: DataFrame | None = None) -> DataFrame:
        """Documents with ``start_pos``, in whole or of the manifest rows in ``parts`` (whose folders alone are listed)."""
        root = os.path.join(self.path, "tokens")
        reader = self.spark.read.option("basePath", root)
        if parts is None:
            t = reader.parquet(root)
        else:
            rows = parts.select("vocab", "split", "part").distinct().collect()      # paths of folders
            if not rows:
                return self.tokens(vocab, split).where(F.lit(False))
            t = reader.parquet(*[os.path.join(root, f"vocab={r['vocab']}", f"split={r['split']}", f"part={r['part']}") for r in rows])
        if vocab is not None:
            t = t.where(F.col("vocab") == vocab)
        if split is not None:
            t = t.where(F.col("split") == split)
        # A row per part and vocabulary, which is far below the documents' number: joined by AQE's choice.
        base = self.manifest.select("vocab", "part", "base").distinct()
        return t.join(base, ["vocab", "part"]).withColumn("start_pos", F.col("base") + F.col("local_pos")).drop("base")

    def span(self, vocab: int, split: str) -> tuple[int, int]:
        """First position of a split, and how many tokens it has."""
        r = self.manifest.where((F.col("vocab") == vocab) & (F.col("split") == split)).agg(
            F.min("lo").alias("lo"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()
        return r["lo"] or 0, r["n"]

    def holding(self, vocab: int, split: str, ranges: DataFrame) -> DataFrame:
        """Manifest rows of the parts that hold a position of ``ranges`` (``first, last``)."""
        m = self.manifest.where((F.col("vocab") == vocab) & (F.col("split") == split) & (F.col("n_tokens") > 0))
        # Both meet on cells of the stream as long as the longest part, so a part lies in two of them at most.
        cell = m.agg(F.max(F.col("hi") - F.col("lo")).alias("n")).first()["n"] or 1

        def cells(first: str, last: Column) -> Column:
            return F.explode(F.sequence(F.expr(f"{first} div {cell}"), F.floor(last / F.lit(cell)).cast("long")))

        parts = m.withColumn("_cell", cells("lo", F.col("hi") - 1))
        asked = ranges.select("first", "last", cells("first", F.col("last")).alias("_asked"))
        return parts.join(asked, (F.col("_cell") == F.col("_asked")) & (F.col("first") < F.col("hi")) & (F.col("last") >= F.col("lo")),
                          "left_semi").drop("_cell").distinct()

    def windows(self, vocab: int, split: str, steps: int, batch: int, block: int, **options) -> DataFrame:
        """:func:`~tokloom.operators.windows.sample_windows` over a split, reading the parts that windows touch."""
        span = self.span(vocab, split)
        starts = window_starts(self.spark, *span, steps, batch, block, **{k: v for k, v in options.items() if k != "chunk"})
        parts = self.holding(vocab, split, starts.select(F.col("w0").alias("first"), (F.col("w0") + block).alias("last")))
        rows = self.tokens(vocab, split, parts).select("start_pos", "n_tokens", "ids")
        return sample_windows(rows, steps, batch, block, span=span, **options)
