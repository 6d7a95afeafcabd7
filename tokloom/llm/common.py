"""Helpers shared by the operators: staged tables, text columns, word cutting.

Staged tables live in the shared folder that ``spark.checkpoint.dir`` names, so
that a lost executor costs a re-read and never a recomputation that could come
out differently.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on (temporaries are ~30x this).
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (lineage ends here)."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_field(schema: T.StructType, name: str, kind: str) -> T.StructType:
    """``schema`` and one more column."""
    return T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark's hash functions take (all but maps and what holds maps)."""
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.typeName() != "variant"]


def held(doc_id: str, k: int, fold_no: int) -> Column:
    """Whether a row lies in the held-out fold; a null id does not."""
    return F.coalesce(fold(doc_id, k) == fold_no, F.lit(False))


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % k


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def global_rank(df: DataFrame, order: Sequence[str], out: str, label: str,
                value: str | None = None, before: str = "before") -> DataFrame:
    """0-based place of each row in the order ``order``, without a single-task sort.

    Rows are range-partitioned (a group of ties is split by the later columns),
    sorted inside each partition and written once; the place is the row's number
    in its partition plus the rows of earlier partitions. The table of
    partition totals has one row per partition, which bounds its broadcast. With
    ``value``, ``before`` is the sum of that column over all earlier rows.
    """
    rows = stage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_m", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    tot = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum(value or F.lit(0)).alias("_v"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"),
                     F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_v0"))
    res = (rows.join(F.broadcast(tot), "_p")
           .withColumn(out, F.col("_n0") + F.col("_m") - F.shiftleft("_p", 33)))
    if value:
        inside = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        res = res.withColumn(before, F.col("_v0") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return res.drop("_p", "_m", "_n0", "_v0")


# --- words of a batch of texts, by numpy on the UTF-8 bytes -------------------------------

def _table(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a:b + 1] = True
    return t


#: Word bytes: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = _table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Anything but ASCII white space.
NOT_SPACE = ~_table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wrap-around arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of some documents in order: byte spans into ``buf``, document, hash."""
    buf: np.ndarray      # bytes of the texts, lower-cased when asked
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray      # index of the document within the slice
    hash: np.ndarray
    n_docs: int
    offsets: np.ndarray  # byte offsets of the documents in ``buf``

    def text(self, i: int) -> str:
        return self.buf[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column (null counts as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    bufs = col.buffers()
    if len(col) == 0 or bufs[1] is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return off, data


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most ``limit`` bytes (one document may exceed it)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def cut_words(off: np.ndarray, data: np.ndarray, a: int, b: int,
              word: np.ndarray = ALNUM, lower: bool = True) -> Words:
    """The words of documents ``a`` to ``b``; ``word`` says which bytes belong to words."""
    lo, hi = int(off[a]), int(off[b])
    buf = data[lo:hi]
    if lower:
        buf = LOWER[buf]
    rel = off[a:b + 1] - lo
    mask = word[buf]
    at = np.flatnonzero(mask)
    n_docs = b - a
    if not len(at):
        z = np.zeros(0, np.int64)
        return Words(buf, z, z, z, np.zeros(0, np.uint64), n_docs, rel)
    first = np.empty(len(buf), bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    cuts = rel[:-1]
    first[cuts[cuts < len(buf)]] = True
    k = np.flatnonzero(first[at])               # index into ``at`` of each word's first byte
    start = at[k]
    size = np.diff(np.append(k, len(at)))
    end = start + size
    inside = np.arange(len(at)) - np.repeat(k, size)
    val = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[inside]
    h = mix64(np.add.reduceat(val, k) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = np.searchsorted(rel, start, "right") - 1
    return Words(buf, start, end, doc, h, n_docs, rel)


def word_strings(w: Words, word: np.ndarray) -> pa.Array:
    """The words as an Arrow array, in order; ``word`` is the table they were cut with."""
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(w.start),
                                 [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.buf[word[w.buf]]))])


def exact_ids(strings: pa.Array) -> np.ndarray:
    """Numbers that are equal exactly where the strings are (told by content, not by a hash)."""
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
