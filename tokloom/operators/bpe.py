"""Byte-level pair-merge (BPE) vocabulary learning as an iterative Spark job.

State: one row per distinct piece, ``piece, cnt, y`` with ``y`` the piece's
current symbols as a delimited string (``|68||101|``). One round learns many merges,
the same ones as merging one pair at a time:

1. Adjacent-pair counts over the state; the top ``fetch`` pairs by (count desc, left id,
   right id) come to the driver. Those counted above ``floor``, the last fetched
   count, are *active*; every other pair occurs at most ``floor`` times.
2. Pieces are cut where two neighbours are no active pair, and equal segments are summed.
   A pair that a merge creates across a cut consists of what an inactive pair became, so it
   occurs at most ``floor`` times too. As long as the most frequent pair is
   counted above ``floor``, the segments therefore hold every occurrence of it.
3. The driver merges on the table of segments (:func:`merge_segments`) until the best pair is no longer above ``floor``. The
   table is bounded: segments are counted first, and while there are more than
   ``MAX_SEGMENTS`` (or their symbols are more than ``MAX_SYMBOLS``) the floor is raised, which leaves
   fewer active pairs and shorter segments. If even that is too much, the round takes what
   the pair counts alone prove (:func:`choose_exact`).
4. The state is rewritten by the round's merges. Pairs are counted anew, or, when
   fewer than half of the pieces changed, the pairs of those pieces are subtracted and added.

The state is persisted each round and written to the reliable checkpoint
folder every few rounds, which cuts the lineage and survives executor loss.

Ids: 0 is the end-of-text special, 1..256 the bytes 0..255, merges follow in
rank order. Ties are broken by (left id, right id), smallest first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.constants import END_OF_TEXT, MAX_VOCAB, MIN_PAIR_FREQUENCY, N_BYTE_SYMBOLS
from ..session import materialize
from .merging import MergeTable, joined, merged, pair_keys, parsed, summed, written
from .pieces import initial_types, pair_rows

FIRST_MERGE_ID = N_BYTE_SYMBOLS + 1

#: Bounds of the table of segments that a round merges on.
MAX_SEGMENTS, MAX_SYMBOLS = 200_000, 1_000_000
#: A round fetches at most so many pairs, also to get past pairs of one count.
MAX_FETCH = 1 << 16

MERGE_SCHEMA = Ty.StructType([
    Ty.StructField("rank", Ty.IntegerType(), False),
    Ty.StructField("left", Ty.IntegerType(), False),
    Ty.StructField("right", Ty.IntegerType(), False),
    Ty.StructField("new_id", Ty.IntegerType(), False),
    Ty.StructField("pair_count", Ty.LongType(), False),
])

VOCAB_SCHEMA = Ty.StructType([
    Ty.StructField("token_id", Ty.IntegerType(), False),
    Ty.StructField("bytes", Ty.BinaryType(), False),
])


def check_vocab_size(vocab_size: int) -> None:
    """Width guard: ids must fit 16 bits."""
    if vocab_size >= MAX_VOCAB:
        raise ValueError(f"a vocabulary of {vocab_size} needs ids wider than 16 bits")
    if vocab_size < FIRST_MERGE_ID:
        raise ValueError(f"vocab {vocab_size} is smaller than the {FIRST_MERGE_ID} base ids")


def choose_exact(top: list[tuple[int, int, int]], wanted: int, fetched_all: bool,
                 min_frequency: int) -> list[tuple[int, int, int]]:
    """Merges from one round that one-at-a-time merging would make next.

    ``top`` is sorted by (count desc, left, right). Merging ``(a, b)`` takes
    nothing from ``(a, z)`` or ``(x, b)``: an ``a`` before ``z`` is not before
    ``b``. It changes only pairs that chain with it, ``(x, a)`` and ``(b, y)``,
    and the pairs it creates, ``(x, ab)`` and ``(ab, y)``, occur no more often
    than those. So the leading run of pairs that do not chain with one already
    taken keeps its counts, and those counted strictly above the first pair
    that does chain stay the maxima in turn. A pair ``(a, a)`` chains with
    itself and is taken alone. The first pair is always exact.
    """
    if not top or wanted <= 0:
        return []
    taken: list[tuple[int, int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    bound = None
    for i, (l, r, c) in enumerate(top):
        if l == r or l in rights or r in lefts:
            if i == 0:
                return [top[0]]
            bound = c
            break
        taken.append((l, r, c))
        lefts.add(l)
        rights.add(r)
    if bound is None:
        bound = (min_frequency - 1) if fetched_all else top[-1][2]
    keep = [taken[0]] + [t for t in taken[1:] if t[2] > bound]
    return keep[:wanted]


@dataclass
class BpeResult:
    merges: DataFrame
    vocab: DataFrame
    types: DataFrame                   # piece, cnt, y: final symbols of every piece
    merge_list: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    rounds: int = 0
    snapshots: dict[int, DataFrame] = field(default_factory=dict)   # vocab -> types

    def merges_for(self, vocab_size: int) -> list[tuple[int, int, int, int, int]]:
        """Merge list of a smaller vocabulary: a prefix of the learned list."""
        return self.merge_list[:max(0, vocab_size - FIRST_MERGE_ID)]


def merge_segments(segments: list[str], counts: list[int], floor: int, wanted: int,
                   next_id: int) -> list[tuple[int, int, int, int]]:
    """``left, right, new id, count`` of the merges that one-at-a-time merging makes
    next, while the most frequent pair of the segments is counted above ``floor``.

    ``segments``: symbols joined by ``||``. All segments lie in one array; a merge compares it with the pair, and only the pairs
    around the places found are counted again.
    """
    if not segments:
        return []
    size = np.array([s.count("||") + 1 for s in segments])
    sym = np.array("||".join(segments).split("||"), dtype=np.int64)
    seg, weight = np.repeat(np.arange(len(size)), size), np.array(counts, np.int64)

    def tally(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at the places ``i``, and how often each occurs."""
        i = np.unique(i[(i >= 0) & (i < len(sym) - 1)])
        i = i[seg[i] == seg[i + 1]]
        key, inv = np.unique(sym[i] * MAX_VOCAB + sym[i + 1], return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, inv, weight[seg[i]])
        return key, n

    held = dict(zip(*(x.tolist() for x in tally(np.arange(len(sym))))))
    heap = [(-c, *divmod(k, MAX_VOCAB)) for k, c in held.items() if c > floor]
    heapq.heapify(heap)
    out: list[tuple[int, int, int, int]] = []
    while heap and len(out) < wanted:
        c, left, right = heapq.heappop(heap)
        now = held.get(left * MAX_VOCAB + right, 0)
        if now != -c:                       # counted when it still occurred more often
            if now > floor:
                heapq.heappush(heap, (-now, left, right))
            continue
        out.append((left, right, next_id, now))
        at = np.flatnonzero((sym[:-1] == left) & (sym[1:] == right) & (seg[:-1] == seg[1:]))
        if left == right:                   # of overlapping places every other one, from the left
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at = at[nth % 2 == 0]
        for k, n in zip(*(x.tolist() for x in tally(np.concatenate([at - 1, at, at + 1])))):
            held[k] -= n
        sym[at] = next_id
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, seg = sym[keep], seg[keep]
        at = at - np.arange(len(at))
        for k, n in zip(*(x.tolist() for x in tally(np.concatenate([at - 1, at])))):
            held[k] = held.get(k, 0) + n
            if held[k] > floor:
                heapq.heappush(heap, (-held[k], *divmod(k, MAX_VOCAB)))
        next_id += 1
    return out


def segment_counts(state: DataFrame, active: list[tuple[int, int, int]]) -> DataFrame:
    """``seg, cnt``: the stretches of symbols (joined by ``||``) whose neighbours are all active
    pairs, equal ones summed."""
    keys = state.sparkSession.sparkContext.broadcast(np.sort(np.array([left * MAX_VOCAB + right for left, right, _ in active], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sym, size = parsed(b.column("y"))
            seg = np.repeat(np.arange(len(size)), size)
            held = np.zeros(len(sym), bool)             # whether a symbol and the next one are an active pair
            i = np.flatnonzero(seg[1:] == seg[:-1])
            held[i] = np.isin(pair_keys(sym[i], sym[i + 1]), keys.value, kind="sort")
            first = np.flatnonzero(held & ~np.concatenate([[False], held[:-1]]))
            n = np.flatnonzero(held & ~np.concatenate([held[1:], [False]])) + 2 - first
            inside = held | np.concatenate([[False], held[:-1]])
            coded = joined(sym[inside], n).dictionary_encode()
            at, sums = summed(coded.indices.to_numpy(zero_copy_only=False), b.column("cnt").to_numpy(zero_copy_only=False)[seg[first]])
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(at)), pa.array(sums)], ["seg", "cnt"])

    return (state.select("y", "cnt").mapInArrow(run, "seg string, cnt long")
            .groupBy("seg").agg(F.sum("cnt").cast("bigint").alias("cnt")))


def _round(state: DataFrame, pairs: DataFrame, wanted: int, next_id: int, min_frequency: int,
           fetch: int, most: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Merges of one round (none when no pair is frequent enough), and how many pairs were active.

    At most ``most`` pairs are tried as active ones, where their counts allow to stop there.
    """
    while True:
        top = _top_pairs(pairs, min_frequency, fetch)
        if not top:
            return [], 0
        floor = min_frequency - 1 if len(top) < fetch else top[-1][2]
        active = [t for t in top if t[2] > floor]
        if active or fetch >= MAX_FETCH:
            break
        fetch = min(fetch * 8, MAX_FETCH)             # all of one count: fetch past them
    if len(active) > most and active[0][2] > active[most][2]:
        floor = active[most][2]
        active = [t for t in active if t[2] > floor]
    while active:
        table = segment_counts(state, active).persist(StorageLevel.MEMORY_AND_DISK)
        size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seg")).alias("chars"),
                         F.sum(F.size(F.split("seg", r"\|\|"))).alias("symbols")).first()
        if size["n"] <= MAX_SEGMENTS and size["symbols"] <= MAX_SYMBOLS:
            rows = table.collect()
            table.unpersist()
            return merge_segments([r["seg"] for r in rows], [r["cnt"] for r in rows], floor, wanted, next_id), len(active)
        table.unpersist()
        floor = active[len(active) // 2][2]
        active = [t for t in active if t[2] > floor]
    got = choose_exact(top, wanted, len(top) < fetch, min_frequency)
    return [(left, right, next_id + i, c) for i, (left, right, c) in enumerate(got)], 1


def rewritten(state: DataFrame, merges: list[tuple[int, int, int, int]]) -> DataFrame:
    """``piece, cnt, y, old``: symbols after ``merges`` in their order; ``old`` is what they were, null if unchanged."""
    table = state.sparkSession.sparkContext.broadcast(
        MergeTable({(left, right): (i, new) for i, (left, right, new, _) in enumerate(merges)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y")
            sym, size = parsed(y)
            sym, n = merged(sym, size, table.value)
            other = n != size
            mask = pa.array(other)
            now = pc.replace_with_mask(y, mask, written(sym[np.repeat(other, n)], n[other]))
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("cnt"), now, pc.if_else(mask, y, pa.scalar(None, pa.string()))],
                                             ["piece", "cnt", "y", "old"])

    return state.select("piece", "cnt", "y").mapInArrow(run, "piece string, cnt long, y string, old string")


def _top_pairs(pair_table: DataFrame, min_frequency: int, fetch: int) -> list[tuple[int, int, int]]:
    """The ``fetch`` most frequent pairs by (count desc, left, right)."""
    t = pair_table.where(F.col("cnt") >= min_frequency)
    rows = t.orderBy(F.desc("cnt"), "left", "right").limit(fetch).collect()
    return [(int(r["left"]), int(r["right"]), int(r["cnt"])) for r in rows]


def _pair_table(rows: DataFrame) -> DataFrame:
    return rows.groupBy("left", "right").agg(F.sum("cnt").cast("bigint").alias("cnt")).where(F.col("cnt") != 0)


def train_bpe(piece_counts: DataFrame, vocab_size: int,
              min_frequency: int = MIN_PAIR_FREQUENCY, fetch: int = 4096, checkpoint_every: int = 4,
              snapshots: list[int] | None = None) -> BpeResult:
    """Learn ``vocab_size - 257`` merges (fewer if no pair reaches ``min_frequency``),
    the same ones as merging one pair at a time.

    ``piece_counts``: ``piece, cnt``. ``snapshots``: smaller vocabulary sizes whose
    piece segmentation is also kept (a round never crosses a snapshot size).
    ``fetch`` bounds the pairs that are active in a round: a smaller number costs
    rounds but never changes the merges.
    """
    check_vocab_size(vocab_size)
    spark: SparkSession = piece_counts.sparkSession
    level = StorageLevel.MEMORY_AND_DISK
    wanted_total = vocab_size - FIRST_MERGE_ID
    types = materialize(initial_types(piece_counts))
    # Pieces of one symbol never change again.
    aside = [types.where(~F.col("y").contains("||"))]
    state = types.where(F.col("y").contains("||")).persist(level)
    pairs = _pair_table(pair_rows(state)).persist(level)
    merges: list[tuple[int, int, int, int, int]] = []
    rounds, most = 0, 64        # a first round of more pairs seldom fits the table of segments, and tries cost a pass each
    targets = sorted({v - FIRST_MERGE_ID for v in (snapshots or []) if FIRST_MERGE_ID <= v < vocab_size})
    snaps: dict[int, DataFrame] = {}

    def union_all(parts):
        out = parts[0]
        for a in parts[1:]:
            out = out.unionByName(a)
        return out

    while len(merges) < wanted_total:
        pending = [t for t in targets if t > len(merges)]
        wanted = (pending[0] if pending else wanted_total) - len(merges)
        got, active = _round(state, pairs, wanted, FIRST_MERGE_ID + len(merges), min_frequency, fetch, most)
        most = max(64, 8 * active)
        if not got:
            break
        merges += [(len(merges) + i, left, right, new, c) for i, (left, right, new, c) in enumerate(got)]
        rounds += 1
        new_state = rewritten(state, got)
        snap_now = len(merges) in targets
        if rounds % checkpoint_every == 0 or snap_now:
            new_state = materialize(new_state)
            aside.append(new_state.where(~F.col("y").contains("||")).drop("old"))
            if snap_now:
                # One table per snapshot: later encodes scan it, not the pieces.
                snap = materialize(union_all([*aside, new_state.where(F.col("y").contains("||")).drop("old")]))
                snaps[len(merges) + FIRST_MERGE_ID] = snap
                aside = [snap.where(~F.col("y").contains("||"))]
            whole = new_state
            new_state = new_state.where(F.col("y").contains("||"))
        else:
            whole = new_state = new_state.persist(level)
        n = whole.agg(F.count(F.lit(1)).alias("all"), F.count("old").alias("changed")).first()
        if 2 * n["changed"] < n["all"]:
            changed = whole.where(F.col("old").isNotNull())
            delta = pair_rows(changed, "y").unionByName(pair_rows(changed, "old").withColumn("cnt", -F.col("cnt")))
            new_pairs = _pair_table(pairs.unionByName(_pair_table(delta)))
            if rounds % checkpoint_every == 0:
                new_pairs = materialize(new_pairs)
        else:
            new_pairs = _pair_table(pair_rows(new_state))
        new_pairs = new_pairs.persist(level)
        new_pairs.count()
        state.unpersist()
        pairs.unpersist()
        state, pairs = new_state, new_pairs
    final_types = materialize(union_all([*aside, state.select("piece", "cnt", "y")]))
    state.unpersist()
    pairs.unpersist()
    for t in targets:
        snaps.setdefault(t + FIRST_MERGE_ID, final_types)
    snaps[vocab_size] = final_types
    merges_df = spark.createDataFrame(merges, MERGE_SCHEMA)
    return BpeResult(merges=merges_df, vocab=vocab_table(spark, merges), types=final_types,
                     merge_list=merges, rounds=rounds, snapshots=snaps)


def vocab_bytes(merges: list[tuple[int, int, int, int, int]]) -> dict[int, bytes]:
    """token id -> byte string; 0 is the special, 1..256 the bytes."""
    out = {0: END_OF_TEXT.encode()}
    for b in range(N_BYTE_SYMBOLS):
        out[b + 1] = bytes([b])
    for _, l, r, new_id, _ in merges:
        out[new_id] = out[l] + out[r]
    return out


def vocab_table(spark: SparkSession, merges) -> DataFrame:
    """``token_id, bytes``; size bounded by the vocabulary width guard."""
    vb = vocab_bytes(merges)
    return spark.createDataFrame(sorted(vb.items()), VOCAB_SCHEMA)


def merges_from_df(merges: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """Merge list from a stored ``merges`` table (bounded by the width guard)."""
    rows = merges.orderBy("rank").collect()
    return [(r["rank"], r["left"], r["right"], r["new_id"], r["pair_count"]) for r in rows]
