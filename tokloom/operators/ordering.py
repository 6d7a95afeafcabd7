"""Order-dependent work without single-task windows.

The reference walks its inputs in order and keeps running totals. Here the
order is a sort key and a running aggregate is computed in two levels:
range-partition on the key (Spark samples the key, so one hot group is spread
over many partitions), aggregate within each partition, combine the
per-partition results (a small table), and add them back. No task holds more
than one range partition, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(agg: str, a, b):
    if agg == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    fn = F.least if agg == "min" else F.greatest
    return fn(a, b)   # least/greatest skip nulls


def running_agg(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                value_col: str, out_col: str, agg: str = "sum",
                inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col``: ``agg`` of ``value_col`` over the rows of the same group
    that come before (``inclusive``: up to and including) each row.

    ``group_cols + order_cols`` must be unique per row. ``agg`` is ``sum``,
    ``min`` or ``max``; a row with nothing before it gets 0 for ``sum`` and
    NULL otherwise. The range-partitioned copy is written once to the
    checkpoint folder: its partition number must mean the same in every branch
    of the plan.
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    key = group_cols + order_cols
    fn = _AGG[agg]
    parts = (df.repartitionByRange(num_partitions, *key) if num_partitions
             else df.repartitionByRange(*key))
    parts = materialize(parts.withColumn("_pid", F.spark_partition_id()))

    # Per (partition, group) segment: one row each, at most partitions + groups.
    seg = parts.groupBy("_pid", *group_cols).agg(fn(value_col).alias("_seg"))
    w_seg = (Window.partitionBy(*group_cols).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1)) if group_cols else \
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carry = seg.select("_pid", *group_cols, fn("_seg").over(w_seg).alias("_carry"))

    frame_end = 0 if inclusive else -1
    w_in = (Window.partitionBy("_pid", *group_cols).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, frame_end))
    local = parts.withColumn("_local", fn(value_col).over(w_in))
    out = join_small(local, carry, ["_pid", *group_cols])
    val = _combine(agg, F.col("_carry"), F.col("_local"))
    if agg == "sum":
        val = val.cast(df.schema[value_col].dataType) if value_col in df.columns else val
    return out.withColumn(out_col, val).drop("_pid", "_carry", "_local")


def running_sum_before(df: DataFrame, order_cols: Sequence[str], value_col: str,
                       out_col: str, num_partitions: int | None = None) -> DataFrame:
    """Sum of ``value_col`` over all rows strictly before each row in ``order_cols``."""
    return running_agg(df, [], order_cols, value_col, out_col, "sum", False, num_partitions)


def rank_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                out_col: str = "k") -> DataFrame:
    """1-based position of each row within its group (``row_number`` without
    putting a whole group in one task)."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_agg(one, group_cols, order_cols, "_one", out_col, "sum",
                       inclusive=True).drop("_one")
