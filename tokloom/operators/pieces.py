"""Pre-token pieces, their frequencies, byte and adjacent-pair histograms.

Pieces, not tokens, are the unit of work: a corpus collapses to far fewer
distinct pieces than it has occurrences, so everything per piece is done once
per distinct piece after a partial (map-side) aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import MAX_VOCAB
from ..sources.tables import spread
from .merging import pair_keys, parsed, summed


def piece_counts(texts: DataFrame, text_col: str = "text",
                 add_prefix_space: bool = True) -> DataFrame:
    """``piece, cnt``: frequency of each distinct piece over all texts."""
    p = spread(texts).select(F.explode(T.pieces(text_col, add_prefix_space)).alias("piece"))
    return p.groupBy("piece").agg(F.count(F.lit(1)).alias("cnt"))


def byte_histogram(counts: DataFrame) -> DataFrame:
    """``byte, cnt``: UTF-8 byte frequencies, each piece weighted by its count."""
    b = counts.select("cnt", F.explode(T.byte_values("piece")).alias("byte"))
    return b.groupBy("byte").agg(F.sum("cnt").cast("bigint").alias("cnt"))


#: Symbols whose pairs a task counts at a time.
COUNTED_SYMBOLS = 1 << 20


def pair_rows(types: DataFrame, sym_col: str = "y", cnt_col: str = "cnt") -> DataFrame:
    """``left, right, cnt``: the adjacent pairs of the symbol strings, weighted by their row's count and summed
    over a bounded number of symbols at a time, so that a pair is far fewer rows than it has places."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, cnt = summed(*(np.concatenate(x) for x in zip(*parts)))
        left, right = np.divmod(key, MAX_VOCAB)
        return pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), pa.array(cnt)],
                                          ["left", "right", "cnt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            sym, size = parsed(b.column(0))
            seg = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(seg[1:] == seg[:-1])
            parts.append((pair_keys(sym[at], sym[at + 1]), b.column(1).to_numpy(zero_copy_only=False)[seg[at]]))
            n += len(at)
            if n >= COUNTED_SYMBOLS:
                yield counted(parts)
                parts, n = [], 0
        if parts:
            yield counted(parts)

    return types.select(sym_col, F.col(cnt_col).cast("bigint").alias("cnt")).mapInArrow(run, "left int, right int, cnt long")


def pair_counts_of(types: DataFrame, sym_col: str = "y") -> DataFrame:
    """``left, right, cnt``: adjacent symbol pairs, weighted by type count.

    Every adjacent position counts, so ``aaa`` holds the pair (a, a) twice.
    ``sym_col`` is the delimited symbol string ``|a||b|...``.
    """
    rows = pair_rows(types.where(F.col(sym_col).contains("||")), sym_col)
    return rows.groupBy("left", "right").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def initial_types(counts: DataFrame) -> DataFrame:
    """``piece, cnt, y``: each distinct piece as its byte symbols (ids byte+1)."""
    return counts.select("piece", F.col("cnt").cast("bigint").alias("cnt"),
                         T.symbol_string("piece").alias("y"))
