"""Shards along a Hilbert curve (operator 10).

Several metadata dimensions are quantised to equally filled cells, each cell
gets its place on a Hilbert curve, rows are sorted by that place and the sorted
run is cut into shards. Neighbours on the curve are neighbours in every
dimension, so a shard's files span narrow ranges of all dimensions at once and
readers can skip them by any of them.

Defined results: a null dimension falls into the lowest cell; null text has no
bytes and no words; an empty table gives no rows; rows that repeat are each
placed; extra columns are ignored by :func:`place` and kept by
:func:`write_shards`. Equal texts share one curve place (that of the group's
least metadata) and lie next to each other, so that a group is divided only
where a cut of the law runs through it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import common


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row each.

    Undoes the rotations from the highest bit down, Gray-codes the result and
    interleaves the bits (Skilling's transposed form).
    """
    x = cells.astype(np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_cuts(rows: DataFrame, name: str, parts: int, label: str) -> list[str]:
    """The least values of a string column with 1, 2, ... of ``parts`` equal shares of its rows at or below them.

    Whole strings are ranked, so values that share a prefix are told apart; at most ``parts - 1`` are gathered.
    """
    counts = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = common.global_rank(counts, ["_s"], "_rank", label, "_c", "_before")
    total = ranked.agg(F.sum("_c")).first()[0] or 1
    passed = f"_before * {parts} div {total}", f"least({parts - 1}, (_before + _c) * {parts} div {total})"
    return sorted((r["_s"] for r in ranked.where(F.expr(f"{passed[0]} < {passed[1]}")).select("_s").collect()),
                  key=lambda v: v.encode("utf-8", "surrogatepass"))


def place(docs: DataFrame, dims: dict[str, Column] | None = None, n_shards: int = 8, bits: int = 5,
          law: str = "rows", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, curve, shard, slot.

    ``dims``: numeric or string expressions over ``docs`` (default: source and
    language, by their whole strings, and size). ``law``: ``rows`` makes counts differ by one
    at most, ``bytes`` cuts where the running size passes equal shares. Size is
    the text's UTF-8 bytes plus 1.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    t = F.col(text_col)
    if dims is None:
        dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.octet_length(t)}
    names = [f"_d{i}" for i in range(len(dims))]
    kinds = docs.select(*[c.alias(n) for n, c in zip(names, dims.values())]).schema
    texts = [n for n in names if isinstance(kinds[n].dataType, StringType)]
    raw = F.coalesce(t, F.lit(""))
    narrow = common.stage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"), F.xxhash64(raw).alias("_h"),
        *[(c if n in texts else c.cast("double")).alias(n) for n, c in zip(names, dims.values())]), "op10-narrow")
    # One place per text: the least metadata of its rows (partial sums first, so a hot text is cheap).
    key = ["_h", "text_crc32", "size"]
    group = common.stage(narrow.groupBy(*key).agg(*[F.min(n).alias(n) for n in names]), "op10-groups")
    cells = (1 << bits) - 1
    for n in texts:
        # The cell is the number of cuts below the value; the cuts of that number are 0, 1, ..., which leave it as it is.
        below = [(F.col(n) > F.lit(c)).cast("double") for c in text_cuts(group, n, cells + 1, "op10-values")]
        group = group.withColumn(n, sum(below, F.lit(0.0)))
    numbers = [n for n in names if n not in texts]
    cut = group.agg(F.count(F.lit(1)), *[F.percentile_approx(n, [(i + 1) / (cells + 1) for i in range(cells)], 10000).alias(n)
                                         for n in numbers]).first()
    cuts = [np.arange(cells, dtype=float) if n in texts else np.unique(np.array(cut[n] if cut[n] is not None else [], float))
            for n in names]

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        pts = [np.where(np.isnan(v), 0, np.searchsorted(c, np.nan_to_num(v), "left"))
               for v, c in ((s.to_numpy(float, na_value=np.nan), c) for s, c in zip(cols, cuts))]
        return pd.Series(hilbert_index(np.stack(pts, 1), bits))

    group = group.select(*key, curve(*names).alias("curve"))
    order = ["curve", "_h", "text_crc32", "size", "doc_id"]
    ranked = common.global_rank(narrow.select("doc_id", *key).join(group, key), order, "_rank", "op10-order",
                                "size" if law == "bytes" else None, "_before")
    n, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if law == "rows":
        # Shard s holds the places from floor(s n / k) on.
        shard = F.expr(f"((_rank + 1) * {n_shards} - 1) div {max(n, 1)}")
        out = ranked.withColumn("shard", shard.cast("int"))
        return (out.withColumn("slot", F.col("_rank") - F.expr(f"(shard * {n}L) div {n_shards}"))
                .select("doc_id", "size", "text_crc32", "curve", "shard", "slot"))
    # bytes: a row belongs to the share in which its middle byte lies.
    out = ranked.withColumn("shard", F.expr(
        f"least({n_shards - 1}, ((2 * _before + size) * {n_shards}) div {2 * max(total, 1)})").cast("int"))
    base = out.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return (out.join(F.broadcast(base), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
            .select("doc_id", "size", "text_crc32", "curve", "shard", "slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, files_per_shard: int = 4,
                 id_col: str = "doc_id") -> DataFrame:
    """Write the rows of ``docs`` as Parquet, one folder per shard, along the curve."""
    keys = [c for c in ("curve", "shard", "slot") if c not in docs.columns]
    rows = docs.join(placed.select(F.col("doc_id").alias(id_col), *keys), id_col)
    (rows.repartitionByRange(files_per_shard * (placed.agg(F.max("shard")).first()[0] or 0) + files_per_shard,
                             "shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
    return docs.sparkSession.read.parquet(path)


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7 under the ``rows`` law."""
    out = place(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
