"""Text -> token ids, ids -> text, token tables.

Encoding is one narrow pass: pieces are cut by the built-in pattern, and an Arrow-batched
helper replaces them by ids for all vocabularies (smaller ones are prefixes of the merge
list). The frequent pieces come from a broadcast dictionary of bounded bytes, segmented by a Spark
job beforehand; the pieces of a batch are looked up in it as one Arrow array and their ids gathered
as arrays, with no Python object per token. Pieces that are not in it are segmented as arrays too, all that a
task looks at in one go (:mod:`~tokloom.operators.merging`). A task holds a bounded number of pieces at a time, whatever the rows of a batch.
Nothing is shuffled but what the caller's keys need. Decoding looks the
ids' bytes up in an array of the vocabulary and stays in built-in expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..sources.tables import spread
from .bpe import FIRST_MERGE_ID, vocab_bytes
from .merging import MergeTable, merged, of_bytes
from .ordering import running_agg

Merge = tuple[int, int, int, int, int]


def _merge_word(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to one piece: repeatedly merge the lowest-rank adjacent pair,
    all its occurrences left to right."""
    while len(ids) > 1:
        best = None
        for a, b in zip(ids, ids[1:]):
            r = ranks.get((a, b))
            if r is not None and (best is None or r[0] < best[0]):
                best = (r[0], r[1], a, b)
        if best is None:
            break
        _, new_id, a, b = best
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                out.append(new_id)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


#: Pieces that a task looks up, and segments where they are not in the dictionary, at a time.
CACHED_PIECES = 1 << 19
#: Pieces whose ids a task gathers at a time; the places of ids take several times their size.
GATHERED_PIECES = 1 << 16
#: Bytes of pieces (and as many ids at most, four bytes each, per vocabulary) in the broadcast dictionary.
DICTIONARY_BYTES = 8 << 20


def rank_tables(merges: list[Merge], sizes: Sequence[int] | None) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """Per vocabulary size (ascending; default: all merges) its merges by pair; bounded by the width guard."""
    counts = [len(merges)] if sizes is None else [max(0, v - FIRST_MERGE_ID) for v in sizes]
    return [{(left, right): (rank, new) for rank, left, right, new, _ in merges[:n]} for n in counts]


def merge_tables(levels) -> list[MergeTable]:
    """The merges of :func:`rank_tables` as arrays."""
    return [MergeTable(ranks) for ranks in levels]


def segmented(pieces: pa.Array, tables: list[MergeTable]) -> list[pa.Array]:
    """Per vocabulary the ids of every piece; each vocabulary goes on from the one before."""
    sym, size = of_bytes(pieces)
    out = []
    for table in tables:
        sym, size = merged(sym, size, table)
        out.append(_lists(sym, size))
    return out


def _lists(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32, copy=False)))


class Table:
    """Pieces and, per vocabulary, their ids end to end with the place where each piece's begin."""

    def __init__(self, pieces: pa.Array, ids: list[pa.Array]) -> None:
        """``ids``: per vocabulary a list of ids per piece."""
        self.pieces = pieces
        self.start = [np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
                      for x in ids]
        self.ids = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for x in ids]


class Encoder:
    """Replaces pieces by ids inside a task. What it holds at a time is bounded by :data:`CACHED_PIECES` and the ids it returns."""

    def __init__(self, tables: list[MergeTable], known: Table) -> None:
        self.tables, self.known = tables, known

    def __call__(self, pieces: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per vocabulary the ids of all ``pieces`` end to end, and the place where each piece's begin."""
        ids, sizes = [[] for _ in self.tables], [[np.zeros(1, np.int64)] for _ in self.tables]
        for i in range(0, len(pieces), CACHED_PIECES):
            at, rest = self._places(pieces.slice(i, CACHED_PIECES))
            for j in range(0, len(at), GATHERED_PIECES):
                for k in range(len(self.tables)):
                    got, size = self._gather(at[j:j + GATHERED_PIECES], rest, k)
                    ids[k].append(got)
                    sizes[k].append(size)
        return [(np.concatenate(x) if x else np.zeros(0, np.int32), np.cumsum(np.concatenate(n))) for x, n in zip(ids, sizes)]

    def _places(self, pieces: pa.Array) -> tuple[np.ndarray, Table]:
        """The place of each piece in the dictionary, or -1 less its place in a table of the pieces that are not in it."""
        at = (pc.index_in(pieces, value_set=self.known.pieces) if len(self.known.pieces)
              else pa.nulls(len(pieces), pa.int32()))
        new = pc.is_null(at)
        coded = pieces.filter(new).dictionary_encode()
        out = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int32)
        out[new.to_numpy(zero_copy_only=False)] = -1 - coded.indices.to_numpy(zero_copy_only=False)
        return out, Table(coded.dictionary, segmented(coded.dictionary, self.tables))

    def _gather(self, at: np.ndarray, rest: Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids by vocabulary ``k`` of the pieces at the places ``at``, and how many each has."""
        size, parts = np.zeros(len(at), np.int64), []
        for where, table in ((at >= 0, self.known), (at < 0, rest)):
            where = np.flatnonzero(where)
            if len(where):
                i = at[where] if table is self.known else -1 - at[where]
                size[where] = table.start[k][i + 1] - table.start[k][i]
                parts.append((where, table.start[k][i], table.ids[k]))
        start = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(int(start[-1]), np.int32)
        for where, begin, held in parts:
            n = size[where]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(start[where], n) + inside] = held[np.repeat(begin, n) + inside]
        return ids, size


def dictionary(types: DataFrame | None, levels, limit: int = DICTIONARY_BYTES) -> Table:
    """The most frequent pieces of ``types`` (``piece, cnt``), at most ``limit`` bytes of them, segmented by a Spark job.

    The count from which on pieces are taken is found from a table of sums by
    powers of the eighth root of two, so a class of equal frequency is in or out as a whole.
    """
    if types is None:
        return Table(pa.array([], pa.string()), [])
    spark = types.sparkSession
    level = F.floor(F.log2("cnt") * 8)
    sized = types.where(F.col("cnt") > 0).withColumn("_b", F.octet_length("piece") + 4).withColumn("_level", level)
    total, least = 0, None
    for r in sorted(sized.groupBy("_level").agg(F.sum("_b").alias("b")).collect(), key=lambda r: -r["_level"]):
        total += r["b"]
        if total > limit:
            break
        least = r["_level"]
    if least is None:
        return Table(pa.array([], pa.string()), [])
    held = spark.sparkContext.broadcast(merge_tables(levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *segmented(b.column(0), held.value)], ["piece", *names])

    names = [f"ids{k}" for k in range(len(levels))]
    schema = ", ".join(["piece string", *(f"{n} array<int>" for n in names)])
    rows = sized.where(F.col("_level") >= least).select("piece").mapInArrow(run, schema).toArrow()
    return Table(rows["piece"].combine_chunks().cast(pa.string()), [rows[n].combine_chunks() for n in names])


def encode_udf(spark: SparkSession, merges: list[Merge], sizes: Sequence[int] | None = None):
    """Arrow UDF ``array<string> of pieces -> array<array<int>>``: the ids by each
    vocabulary in ``sizes`` (ascending; default: all merges), for a column of any table. The merge list is
    bounded by the width guard and broadcast once."""
    bc = spark.sparkContext.broadcast(merge_tables(rank_tables(merges, sizes)))

    @F.arrow_udf(Ty.ArrayType(Ty.ArrayType(Ty.IntegerType())))
    def _enc(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(bc.value, Table(pa.array([], pa.string()), []))
        for s in lists:
            cut, n = _cuts(s), len(bc.value)
            by_vocab = pa.concat_arrays([_lists(ids, np.diff(start[cut])) for ids, start in encoder(s.flatten())])
            order = np.arange(n * len(s)).reshape(n, len(s)).T.ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(s) + 1, n, dtype=np.int32)), by_vocab.take(pa.array(order)))

    return _enc


def _cuts(lists: pa.Array) -> np.ndarray:
    """Where each row's pieces begin among those of all rows, and their end; a null has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _runs_of_rows(cut: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows ``first, end`` that follow each other and hold at most ``most`` pieces (or are one row)."""
    at = 0
    while at < len(cut) - 1:
        end = max(at + 1, int(np.searchsorted(cut, cut[at] + most, "right")) - 1)
        yield at, end
        at = end


def vocab_hex(merges: list[tuple[int, int, int, int, int]]) -> list[str]:
    """Per id the hex code of its bytes."""
    return [b.hex().upper() for _, b in sorted(vocab_bytes(merges).items())]


def decoded(df: DataFrame, merges: list[tuple[int, int, int, int, int]], out: str, ids_col: str = "ids",
            sep: str | None = None) -> DataFrame:
    """``df`` with ``out``, the text of ``ids_col``; broken UTF-8 becomes U+FFFD.

    With ``sep`` each id is decoded by itself (possibly half a character),
    stripped, and the parts are joined by it.
    """
    table = F.split(F.lit(",".join(vocab_hex(merges))), ",")     # a constant, folded once

    def text(h):
        return F.make_valid_utf8(F.unhex(h).cast("string"))

    if sep is None:
        h = F.array_join(F.transform(ids_col, lambda i: F.element_at(table, i + 1)), "")
        return df.withColumn(out, text(h))
    parts = F.transform(ids_col, lambda i: F.regexp_replace(text(F.element_at(table, i + 1)), T.STRIP, ""))
    return df.withColumn(out, F.array_join(parts, sep))


def encode_texts(texts: DataFrame, text_col: str, key_cols: Sequence[str],
                 merges: list[Merge], sizes: Sequence[int] | None = None,
                 add_prefix_space: bool = True, types: DataFrame | None = None, positions: bool = False) -> DataFrame:
    """``key_cols..., ids, n_tokens``: each text encoded whole (one prefix space). Null text has no ids.

    With ``sizes`` a row per text and vocabulary size, named in ``vocab``. ``types``: pieces and their counts, of which the frequent
    ones become the dictionary. With ``positions`` rows are taken in the order they come in and get ``part``, the partition, and
    ``local_pos``, the tokens of their vocabulary before them in it.
    """
    levels = rank_tables(merges, sizes)
    spark = texts.sparkSession
    bc = spark.sparkContext.broadcast((merge_tables(levels), dictionary(types, levels)))
    rows = texts if positions else spread(texts)
    src = rows.select(*key_cols, F.coalesce(T.pieces(text_col, add_prefix_space), F.array().cast("array<string>")).alias("_pieces"))
    fields = list(src.schema.fields)[:-1]
    extra = [("ids", "array<int>"), ("n_tokens", "int")] + ([("vocab", "int")] if sizes is not None else []) + (
        [("part", "int"), ("local_pos", "long")] if positions else [])
    schema = Ty.StructType([*fields, *(Ty.StructField(n, Ty._parse_datatype_string(t)) for n, t in extra)])
    vocabs = list(sizes) if sizes is not None else [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part = Encoder(*bc.value), TaskContext.get().partitionId()
        at = [0] * len(vocabs)
        for whole in batches:
            for first, end in _runs_of_rows(_cuts(whole.column(len(fields))), CACHED_PIECES):
                b = whole.slice(first, end - first)
                lists = b.column(len(fields))
                cut = _cuts(lists)
                for k, (ids, start) in enumerate(encoder(lists.flatten())):
                    ends = start[cut]
                    n = np.diff(ends)
                    cols = [*b.columns[:len(fields)], _lists(ids, n), pa.array(n.astype(np.int32))]
                    if sizes is not None:
                        cols.append(pa.array(np.full(len(b), vocabs[k], np.int32)))
                    if positions:
                        cols += [pa.array(np.full(len(b), part, np.int32)), pa.array(at[k] + ends[:-1])]
                        at[k] += int(ends[-1])
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

    return src.mapInArrow(run, schema)


def token_positions(tokens: DataFrame) -> DataFrame:
    """``vocab, start_byte, start_pos``: each document's first token position in its
    vocabulary's stream in corpus order, for token tables stored without positions. The prefix sum reads three narrow columns."""
    narrow = tokens.select("vocab", "start_byte", F.col("n_tokens").cast("long").alias("n_tokens"))
    pos = running_agg(narrow, ["vocab"], ["start_byte"], "n_tokens", "start_pos")
    return pos.select("vocab", "start_byte", F.col("start_pos").cast("bigint").alias("start_pos"))


def token_totals(tokens: DataFrame) -> DataFrame:
    """``vocab, split, n_tokens`` per split plus each vocabulary's total (split NULL)."""
    return tokens.cube("split", "vocab").agg(F.sum("n_tokens").cast("bigint").alias("n_tokens")).where("vocab is not null")
