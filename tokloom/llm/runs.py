"""Periodic run detection by recompression (operator 13).

The words of a stretch of texts are numbered by content and compressed into a
run-length grammar: rounds alternate between block compression (a maximal run of
one symbol becomes one symbol, told by letter and length) and pair compression
(symbols are divided into left and right ones; every left one before a right
one becomes one symbol with it). Both cut equal stretches alike except at their
ends, so the longest common extension of two places is found by climbing the
levels with at most one comparison each and coming down again.

Candidates lie on a harmonic grid: a run of period p and at least 2p words holds
two neighbouring multiples of p, where the words are equal. Every such pair
whose words (and those of a neighbour on one side) agree is extended exactly in
both directions by the grammar. Stretches found by several periods belong to the least.

A run is a stretch of words with smallest period q and at least max(12, 2q)
words which no neighbouring word extends keeping q. Collapsing a text keeps of
every run its first q words.

Defined results: null, empty and blank texts have no words and no runs and
collapse to the empty text; texts of any length are searched whole; rows that
repeat, also with null ids, get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS = 12
#: Grid places that are looked at in one step (about 40 bytes each).
GRID_STEP = 1 << 20

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Grammar:
    """Recompression of a sequence of symbols (non-negative integers).

    ``seq[t]`` is the sequence of level t; ``up[t][k]`` says in which symbol of
    level t + 1 its symbol k lies, ``lo[t][s]`` where symbol s of level t + 1 begins in level t.
    Even levels are compressed by blocks, odd ones by pairs.
    """

    def __init__(self, seq: np.ndarray) -> None:
        self.seq, self.up, self.lo = [seq.astype(np.int64)], [], []
        while len(self.seq[-1]) > 1:
            s = self.seq[-1]
            first = self._blocks(s) if len(self.up) % 2 == 0 else self._pairs(s, len(self.up))
            lo = np.flatnonzero(first)
            size = np.diff(np.append(lo, len(s)))
            # Symbols that stand alone keep their number; the others are numbered by what they stand for.
            new = np.flatnonzero(size > 1)
            rest = size[new] if len(self.up) % 2 == 0 else s[lo[new] + 1]
            out, base = s[lo], np.int64(s.max() + 1)
            if len(new):
                out[new] = base + np.unique(out[new] * (rest.max() + 1) + rest, return_inverse=True)[1]
            self.up.append(np.cumsum(first) - 1)
            self.lo.append(np.append(lo, len(s)))
            self.seq.append(out)

    @staticmethod
    def _blocks(s: np.ndarray) -> np.ndarray:
        first = np.ones(len(s), bool)
        first[1:] = s[1:] != s[:-1]
        return first

    @staticmethod
    def _pairs(s: np.ndarray, level: int) -> np.ndarray:
        """Where symbols begin after pairing; no two neighbours of ``s`` are equal."""
        best = None
        for k in range(4):                         # of some divisions of the symbols the one that pairs most
            right = common.mix64(s.astype(np.uint64) + np.uint64((4 * level + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1) == 1
            second = np.zeros(len(s), bool)
            second[1:] = right[1:] & ~right[:-1]
            if best is None or second.sum() > best.sum():
                best = second
        return ~best

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many symbols from ``i`` and ``j`` on (or back) agree, pair by pair; ``i`` and ``j`` differ and
        meet unequal symbols before the ends."""
        a, b = i.astype(np.int64).copy(), j.astype(np.int64).copy()
        top = np.zeros(len(a), np.int64)           # level at which the two are found to differ
        live = np.arange(len(a))
        step = 1 if forward else -1
        for t in range(len(self.up) + 1):
            x, y = a[live], b[live]
            s = self.seq[t]
            same = s[x] == s[y]
            top[live[~same]] = t
            live, x, y = live[same], x[same], y[same]
            if not len(live):
                break
            up, lo = self.up[t], self.lo[t]
            rx, ry = self._left(up, lo, x, forward), self._left(up, lo, y, forward)
            bx, by = self._at_edge(up, lo, x, forward), self._at_edge(up, lo, y, forward)
            inner = ~(bx & by)
            m = np.where(inner, np.minimum(rx, ry), 0)
            x, y = x + step * m, y + step * m
            a[live], b[live] = x, y
            differ = inner & (rx != ry)            # one block is longer: the next symbols differ
            top[live[differ]] = t
            go = ~differ
            live, x, y = live[go], x[go], y[go]
            a[live], b[live] = up[x], up[y]
        for t in range(int(top.max(initial=0)), 0, -1):
            q = np.flatnonzero(top >= t)
            lo, s = self.lo[t - 1], self.seq[t - 1]
            x, y = a[q], b[q]
            sx, sy = lo[x + 1] - lo[x], lo[y + 1] - lo[y]
            x, y = (lo[x], lo[y]) if forward else (lo[x + 1] - 1, lo[y + 1] - 1)
            m = np.where(s[x] == s[y], np.minimum(sx, sy) if t % 2 == 1 else 1, 0)
            a[q], b[q] = x + step * m, y + step * m
        return (a - i) * step

    @staticmethod
    def _left(up: np.ndarray, lo: np.ndarray, x: np.ndarray, forward: bool) -> np.ndarray:
        """Symbols from ``x`` to the end of the one above, in the direction of reading."""
        return lo[up[x] + 1] - x if forward else x - lo[up[x]] + 1

    @staticmethod
    def _at_edge(up: np.ndarray, lo: np.ndarray, x: np.ndarray, forward: bool) -> np.ndarray:
        return lo[up[x]] == x if forward else lo[up[x] + 1] - 1 == x


def candidates(ids: np.ndarray, end: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, period`` of neighbouring grid places of one text whose words agree, and those beside them too.

    ``ids``: symbols of texts divided by symbols that occur once; ``end``: where each symbol's
    text ends; ``longest``: words of the longest text.
    """
    n, got, periods, held = len(ids), [], [], 0

    def some() -> tuple[np.ndarray, np.ndarray]:
        i, p = np.concatenate(got), np.concatenate(periods)
        i, p = i[i + p < end[i]], p[i + p < end[i]]
        near = (ids[i + 1] == ids[np.minimum(i + p + 1, n - 1)]) | (ids[i - 1] == ids[i + p - 1])
        return i[near], p[near]

    for p in range(1, longest // 2 + 1):
        x = ids[p::p]                               # the first place is a divider
        hit = np.flatnonzero(x[1:] == x[:-1])
        if len(hit):
            got.append((hit + 1) * p)
            periods.append(np.full(len(hit), p))
            held += len(hit)
        if held >= GRID_STEP:
            yield some()
            got, periods, held = [], [], 0
    if held:
        yield some()


def runs_of(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of every run, by text, start and period; ``ids`` are the
    words of all texts in order, ``sizes`` how many each text has."""
    none = np.zeros(0, np.int64)
    if not len(ids) or sizes.max() < LEAST_WORDS:
        return none, none, none, none
    # Dividers, which occur once, stand before, between and after the texts.
    k = len(sizes)
    shift = np.repeat(np.arange(1, k + 1), sizes)
    seq = np.empty(len(ids) + k + 1, np.int64)
    at = np.arange(len(ids)) + shift
    seq[at] = ids + k + 1
    div = np.concatenate([[0], np.cumsum(sizes + 1)])
    seq[div] = np.arange(k + 1)
    end = np.empty(len(seq), np.int64)
    end[at] = np.repeat(div[1:], sizes)
    end[div] = div
    grammar, found = None, []
    for i, p in candidates(seq, end, int(sizes.max())):
        if not len(i):
            continue
        grammar = grammar or Grammar(seq)
        s = i - grammar.extension(i - 1, i + p - 1, False)
        e = i + p + grammar.extension(i, i + p, True)
        ok = e - s >= np.maximum(2 * p, LEAST_WORDS)
        found.append(np.unique(np.stack([s[ok], e[ok], p[ok]], 1), axis=0))
    if not found:
        return none, none, none, none
    rows = np.unique(np.concatenate(found), axis=0)           # by start, end, period
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    s, e, p = rows[least].T
    o = np.lexsort((p, s))
    s, e, p = s[o], e[o], p[o]
    text = np.searchsorted(div, s, "right") - 1
    return text, s - div[text] - 1, e - s, p


Rewrite = Callable[[np.ndarray, pa.Array, np.ndarray], np.ndarray]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of every text by start and period, and the
    text without their repeats, words joined by one space.

    ``rewrite(sizes, doc_ids, at)`` may give other places of the word sequence to read the words from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = common.text_bytes(b.column(1))
            for i, j in common.slices(off):
                w = common.cut_words(off, data, i, j, common.NOT_SPACE, lower=False)
                words, sizes = common.word_strings(w, common.NOT_SPACE), w.per_doc().astype(np.int64)
                if rewrite is not None:
                    words = words.take(pa.array(rewrite(sizes, b.column(0).slice(i, j - i), np.arange(len(words)))))
                text, start, length, period = runs_of(common.exact_ids(words), sizes)
                yield _rows(b.column(0).slice(i, j - i), words, sizes, text, start, length, period)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, SCHEMA))


def _rows(doc_ids: pa.Array, words: pa.Array, sizes: np.ndarray, text: np.ndarray, start: np.ndarray,
          length: np.ndarray, period: np.ndarray) -> pa.RecordBatch:
    """Result rows of some texts."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    # Where a run's repeats begin and end; a word goes when more of them began than ended.
    depth = (np.bincount(first[text] + start + period, minlength=len(words) + 1)
             - np.bincount(first[text] + start + length, minlength=len(words) + 1))
    keep = np.cumsum(depth)[:len(words)] == 0
    kept = words.filter(pa.array(keep)).cast(pa.large_string())
    left = np.concatenate([[0], np.cumsum(keep)])[first]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), kept), pa.scalar(" ", pa.large_string()))
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [doc_ids, pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), found), joined.cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"])


def echoed_tails(sizes: np.ndarray, doc_ids: pa.Array, at: np.ndarray) -> np.ndarray:
    """Of a tenth of the texts the tail repeats a part of itself, as the query's contract has it: with
    h = crc32 of the id and g = h div 10, from word a = g mod n on every word is that of a + (i - a) mod p."""
    at, first = at.copy(), 0
    for n, doc in zip(sizes.tolist(), doc_ids.to_pylist()):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first + a:first + n] = first + a + np.arange(n - a) % p
        first += n
    return at


def digests(found: DataFrame) -> DataFrame:
    """Of each text the number of runs, the longest (ties: smallest start, then period), and digests of all runs
    and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"),
                       F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"),
                       F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"), "n_words")
    return out.select("doc_id", "n_runs", (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"),
                      (-F.col("_b.period")).alias("period"), F.expr("(1000 * _b.length) div (-_b.period)").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256", "n_words")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, a tenth of them with repeating tails."""
    return digests(detect(common.read(spark, sf_dir, "documents"), rewrite=echoed_tails))
