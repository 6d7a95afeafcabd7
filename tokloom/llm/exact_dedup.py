"""Exact deduplication by Grace hashing (operator 6).

Every scan task first folds its own copies (a hot text leaves a task as a few
rows, whatever its number of copies). Texts that still have many folded rows are
combined a few rows at a time, level by level, each step comparing complete contents, so that
no task gets all rows of a text. The distinct texts are then divided by
hash into buckets; buckets whose texts would not fit an in-memory table are
written to spill files in the shared folder and divided again by another hash,
until every bucket fits. A bucket is resolved by an open-addressing table that
compares complete contents. Answers return to the documents by the number of
the folded row, which is unique, so no join has a hot key.

Defined results: null text counts as empty; a null id sorts below every id, and
when all ids of a group are null the row kept is one of them; of rows that tie
on the largest id exactly one is kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Ids that one folded row holds; a text with more copies in a task gets several rows.
IDS_PER_ROW = 4096
#: Folded rows of one hash from which on they are combined first, about half as many at a time.
CROWDED = 16


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self, slots: int = 1 << 10):
        self.slot = [-1] * slots
        self.hash: list[int] = []
        self.content: list[bytes] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> int:
        """Number of ``content``; a new one is added."""
        mask = len(self.slot) - 1
        i = h & mask
        while (e := self.slot[i]) >= 0:
            if self.hash[e] == h and self.content[e] == content:
                return e
            i = (i + 1) & mask
        e = len(self.hash)
        self.slot[i] = e
        self.hash.append(h)
        self.content.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.hash) > len(self.slot):
            self._grow()
        return e

    def _grow(self) -> None:
        mask = 2 * len(self.slot) - 1
        self.slot = [-1] * (mask + 1)
        for e, h in enumerate(self.hash):
            i = h & mask
            while self.slot[i] >= 0:
                i = (i + 1) & mask
            self.slot[i] = e


def _above(a, b):
    """The larger id; null is below all."""
    return b if a is None else a if b is None or a >= b else b


FOLDED = "row long, h long, text string, sha string, n long, max_id long, ids array<long>"


def _fold(limit: int):
    schema = pa.schema([("row", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("sha", pa.string()),
                        ("n", pa.int64()), ("max_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 40, 0
        table, sha, ids = ContentTable(), [], []

        def out(which: list[int]) -> pa.RecordBatch:
            nonlocal made
            rows = range(task + made, task + made + len(which))
            made += len(which)
            tops = []
            for e in which:
                top = None
                for x in ids[e]:
                    top = _above(top, x)
                tops.append(top)
            return pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()), pa.array([table.hash[e] for e in which], pa.int64()),
                pa.array([table.content[e] for e in which], pa.binary()).cast(pa.string()),
                pa.array([sha[e] for e in which], pa.string()), pa.array([len(ids[e]) for e in which], pa.int64()),
                pa.array(tops, pa.int64()), pa.array([ids[e] for e in which], pa.list_(pa.int64()))], schema=schema)

        for b in batches:
            off, data = common.text_bytes(b.column("text"))
            view = memoryview(data)
            for i, (doc, h, s) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "sha")))):
                e = table.find(h, bytes(view[off[i]:off[i + 1]]))
                if e == len(ids):
                    ids.append([])
                    sha.append(s)
                ids[e].append(doc)
                if len(ids[e]) >= IDS_PER_ROW:
                    yield out([e])
                    ids[e] = []
                if table.bytes > limit:
                    yield out([e for e in range(len(ids)) if ids[e]])
                    table, sha, ids = ContentTable(), [], []
        if ids:
            yield out([e for e in range(len(ids)) if ids[e]])

    return fold


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket; one table per bucket."""
    bucket, table, groups = None, ContentTable(), []

    def out() -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for keep, n, keep_row, rows in groups:
            for r in rows:
                for c, v in zip(cols, (r, keep, n, keep_row)):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          ["row", "keep_id", "group_size", "keep_row"])

    for b in batches:
        off, data = common.text_bytes(b.column("text"))
        view = memoryview(data)
        cols = (b.column(c).to_pylist() for c in ("bucket", "row", "h", "n", "max_id"))
        for i, (k, row, h, n, top) in enumerate(zip(*cols)):
            if k != bucket:
                if groups:
                    yield out()
                bucket, table, groups = k, ContentTable(), []
            e = table.find(h, bytes(view[off[i]:off[i + 1]]))
            if e == len(groups):
                groups.append([top, n, row, [row]])
                continue
            g = groups[e]
            new = _above(g[0], top)
            if new != g[0] or (new == top and row < g[2]):
                g[2] = row
            g[0], g[1] = new, g[1] + n
            g[3].append(row)
    if groups:
        yield out()


COMBINED = "row long, h long, text string, n long, max_id long, members array<long>"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (h, part); rows of equal content in a part become the one with the largest id."""
    group, table, held = None, ContentTable(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([g[0] for g in held], pa.int64()), pa.array(table.hash, pa.int64()),
            pa.array(table.content, pa.binary()).cast(pa.string()), pa.array([g[1] for g in held], pa.int64()),
            pa.array([g[2] for g in held], pa.int64()), pa.array([g[3] for g in held], pa.list_(pa.int64()))],
            ["row", "h", "text", "n", "max_id", "members"])

    for b in batches:
        off, data = common.text_bytes(b.column("text"))
        view = memoryview(data)
        cols = (b.column(c).to_pylist() for c in ("h", "part", "row", "n", "max_id"))
        for i, (h, part, row, n, top) in enumerate(zip(*cols)):
            if (h, part) != group:
                if held:
                    yield out()
                group, table, held = (h, part), ContentTable(8), []
            e = table.find(h, bytes(view[off[i]:off[i + 1]]))
            if e == len(held):
                held.append([row, n, top, [row]])
                continue
            g = held[e]
            new = _above(g[2], top)
            if new != g[2] or (new == top and row < g[0]):
                g[0] = row
            g[1], g[2] = g[1] + n, new
            g[3].append(row)
    if held:
        yield out()


def _thinned(folded: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``row, h, text, n, max_id`` with at most :data:`CROWDED` rows of a text (and as many of each other text of its
    hash), and per level which row (``member``) went into which (``into``)."""
    rows, links = folded.select("row", "h", "text", "n", "max_id"), []
    while True:
        level = len(links)
        crowd = common.stage(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED), f"op6-crowd{level}")
        if not crowd.take(1):
            return rows, links
        hot = rows.join(crowd, "h")
        part = F.pmod(F.xxhash64("row", F.lit(level)), F.ceil(F.col("rows") * 2 / F.lit(CROWDED)))
        some = common.stage(hot.withColumn("part", part).select("h", "part", "row", "n", "max_id", "text")
                            .repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_combine, COMBINED), f"op6-combined{level}")
        gone = common.stage(some.select(F.col("row").alias("into"), F.explode("members").alias("member")).where("member <> into"),
                            f"op6-links{level}")
        links.append(gone)
        rows = rows.join(crowd, "h", "left_anti").unionByName(some.drop("members"))
        if not gone.take(1):     # many texts of one hash, none of them twice in a part
            return rows, links


def dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, table_bytes: int = 32 << 20,
          fan_out: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    ``table_bytes`` bounds the contents that one in-memory table holds, and with
    it the bytes a bucket may have before it is divided ``fan_out`` ways again.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("h"),
                       F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    folded = common.stage(rows.mapInArrow(_fold(table_bytes), FOLDED), "op6-folded")
    # What each bucket would hold: every text once.
    thin, links = _thinned(folded)
    texts = thin.groupBy("h").agg(F.max(F.octet_length("text")).alias("size"))
    total = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // table_bytes))
    open_, level, done = thin, 0, None
    while True:
        bucket = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(n)) if level == 0 else F.concat_ws(
            "/", "bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(fan_out)).cast("string"))
        open_ = open_.withColumn("bucket", bucket.cast("string"))
        load = (open_.groupBy("bucket", "h").agg(F.max(F.octet_length("text") + 64).alias("size"))
                .groupBy("bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts")))
        over = common.stage(load.where((F.col("size") > table_bytes) & (F.col("texts") > 1)).select("bucket"),
                            f"op6-over{level}")
        spill = bool(over.take(1))
        fits = open_.join(over, "bucket", "left_anti") if spill else open_
        answer = (fits.select("bucket", "row", "h", "n", "max_id", "text")
                  .repartition("bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_resolve, "row long, keep_id long, group_size long, keep_row long"))
        done = answer if done is None else done.unionByName(answer)
        if not spill:
            break
        open_ = common.stage(open_.join(over, "bucket", "left_semi"), f"op6-spill{level}")
        level += 1
    for gone in reversed(links):
        done = done.unionByName(gone.join(done, gone["into"] == done["row"]).select(
            F.col("member").alias("row"), "keep_id", "group_size", "keep_row"))
    out = folded.select("row", "sha", "ids").join(done, "row")
    first = F.when(F.col("keep_id").isNull(), 1).otherwise(F.array_position("ids", F.col("keep_id")))
    return (out.withColumn("at", F.when(F.col("row") == F.col("keep_row"), first).otherwise(0))
            .select("keep_id", "group_size", "sha", "at", F.posexplode("ids").alias("pos", "doc_id"))
            .select("doc_id", "keep_id", "group_size", (F.col("pos") + 1 == F.col("at")).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts among all documents; the largest id stays."""
    return dedup(common.read(spark, sf_dir, "documents"))
