"""Language-model scores by online logistic context mixing (operator 4).

The tokens of the training texts are counted exactly. Words that counts cannot
vouch for are spelled bit by bit: a byte's Huffman code gives the bits, five
hashed contexts (the last one, two, three and five bytes and the whole prefix of
the word) predict each, and a logistic mixer, its weights gated by how many
contexts have been seen and by the place in the word, combines them; an adaptive
map refines the result. The mixer and the map learn online, predicting each word
of a partition before learning from it with the word's own counts taken out;
partitions run from the same start and are averaged.

A token's probability interpolates its discounted count with its spelling. Inside
a text further logistic mixers, which start afresh in every text and learn from
each token after predicting it, weigh this against what followed the word before
in the training texts (hashed pair counts, a training text's own occurrence taken
out) and against the words the text has used so far. Every distribution sums to
one but for hash collisions, so the score is the log10 probability of the text as
a sequence of tokens; with the text's bytes it gives bits per byte.

What is gathered (the vocabulary and the pair counts) grows with the corpus and
is only ever shuffled: each block of texts sends its distinct words and pairs and
gets their counts. Pair hashes lie in 2^32 places per bucket, and there is a
bucket per 8 MB of text, so collisions stay as rare at any size. The bit
statistics are a hashed table of fixed size, whose collisions the mixer learns to
live with.

Defined results: null text is empty and has one token, its end; without any
training text counts are zero and spellings uniform; rows that repeat are scored
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SLOT_BITS = 21                       # hashed bit statistics: 2^21 pairs of counts
SLOTS = 1 << SLOT_BITS
ORDERS = 5                           # last 1, 2, 3, 5 bytes; whole prefix
PLACES = 3                           # first, second, later byte of a word
INPUTS = ORDERS + 1                  # and a constant
LEVELS = 24                          # steps of the adaptive map
CHUNK = 1 << 14                      # slots per row when counts are summed
WORD_END = 0x20                      # the byte that ends a spelling; no word holds it
MAP_RATE, TEXT_RATE = 0.5, 0.02
PAIR_GATES = 24                      # by how often the word before occurs, in powers of two


# --- spelling ------------------------------------------------------------------------------

@dataclass
class Code:
    """A binary code of the bytes: per byte its length, its bits and the tree nodes on its path."""
    length: np.ndarray
    bit: np.ndarray
    node: np.ndarray


def huffman(count: np.ndarray) -> Code:
    """Huffman code of the 256 bytes; every byte counts once more than seen."""
    heap = [(int(c) + 1, b, None) for b, c in enumerate(count)]
    heapq.heapify(heap)
    made = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a, b)))
        made += 1
    length, paths = np.zeros(256, np.int64), [[] for _ in range(256)]
    todo = [(heap[0], [])]
    while todo:
        (_, name, kids), path = todo.pop()
        if kids is None:
            paths[name], length[name] = path, len(path)
        else:
            todo += [(kids[0], [*path, (name, 0)]), (kids[1], [*path, (name, 1)])]
    deep = int(length.max())
    bit, node = np.zeros((256, deep), np.uint8), np.zeros((256, deep), np.uint64)
    for b, path in enumerate(paths):
        for d, (name, v) in enumerate(path):
            bit[b, d], node[b, d] = v, name
    return Code(length, bit, node)


def word_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words, each followed by the end byte; word and place of every byte."""
    off, data = common.text_bytes(col)
    size = np.diff(off)
    word = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    out = np.full(len(word), WORD_END, np.uint8)
    out[place < size[word]] = data[off[0]:off[-1]]
    return out, word, place


def contexts(b: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """A hash per order for every byte, of what precedes it in its word."""
    before = []
    for k in range(1, 6):
        x = np.zeros(len(b), np.uint64)
        x[k:] = b[:-k]
        before.append(np.where(place >= k, x + np.uint64(1), np.uint64(0)))
    out, h = [], np.zeros(len(b), np.uint64)
    for k, x in enumerate(before, 1):
        h = h * np.uint64(0x2545F4914F6CDD1D) + x
        if k in (1, 2, 3, 5):
            out.append(common.mix64(h + np.uint64(k << 50)))
    # Hash of the whole prefix: running sum of placed bytes less its value where the word began.
    run = np.cumsum((b.astype(np.uint64) + np.uint64(1)) * common.powers(int(place.max(initial=0)) + 1)[place])
    run = np.concatenate([np.zeros(1, np.uint64), run[:-1]])
    start = np.flatnonzero(place == 0)
    base = run[start][np.cumsum(place == 0) - 1]
    out.append(common.mix64((run - base) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out


def bits(b: np.ndarray, place: np.ndarray, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per depth of the code: the bytes that are that deep, their bits, and slots per order."""
    ctx = contexts(b, place)
    live = np.arange(len(b))
    for d in range(code.bit.shape[1]):
        live = live[code.length[b[live]] > d]
        if not len(live):
            return
        node = code.node[b[live], d] * np.uint64(0x9E3779B97F4A7C15)
        yield live, code.bit[b[live], d], np.stack(
            [((c[live] + node) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for c in ctx])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


@dataclass
class Speller:
    """Bit statistics, gated mixer weights and the adaptive map."""
    code: Code
    zero: np.ndarray
    one: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.full((INPUTS, (ORDERS + 1) * PLACES), 0.3, np.float32))
    seen: np.ndarray = field(default_factory=lambda: np.zeros(PLACES * LEVELS * 2))
    stretch: np.ndarray | None = None

    def learned(self, own: np.ndarray, slots: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions per order and the gate, each bit's own count left out."""
        n0, n1 = self.zero[slots], self.one[slots]
        bit = own.astype(np.float32)
        n1 = np.maximum(n1 - bit, 0)
        n0 = np.maximum(n0 - (1 - bit), 0)
        return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))), (n0 + n1 > 0).sum(0) * PLACES + place

    def known(self, slots: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with all counts, from a table made on first use (a seen context is never exactly 0)."""
        if self.stretch is None:
            x = np.log((self.one + np.float32(0.4)) / (self.zero + np.float32(0.4)))
            self.stretch = np.where((x == 0) & (self.one + self.zero > 0), np.float32(1e-6), x)
        x = self.stretch[slots]
        return x, (x != 0).sum(0) * PLACES + place

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = self.weights[ORDERS, gate] * np.float32(0.3)
        for i in range(ORDERS):
            z += self.weights[i, gate] * x[i]
        return np.clip(z, -12, 12)

    @staticmethod
    def cell(z: np.ndarray, place: np.ndarray) -> np.ndarray:
        return place * LEVELS + np.clip((z + 6) * (LEVELS / 12), 0, LEVELS - 1).astype(np.int64)

    def refined(self, z: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Final probability of a one: the mixer's, averaged with what the map has seen at that level."""
        p = sigmoid(z)
        at = self.cell(z, place) * 2
        n0, n1 = self.seen[at], self.seen[at + 1]
        return np.clip((1 - MAP_RATE) * p + MAP_RATE * (n1 + 8 * p) / (n0 + n1 + 8), 1e-6, 1 - 1e-6)

    def log10(self, col: pa.Array) -> np.ndarray:
        """log10 probability of each word's spelling."""
        b, word, place = word_bytes(col)
        low = np.minimum(place, PLACES - 1)
        total = np.zeros(len(b))
        for live, bit, slots in bits(b, place, self.code):
            x, gate = self.known(slots, low[live])
            p = self.refined(self.mixed(x, gate), low[live])
            total[live] += np.log10(np.where(bit == 1, p, 1 - p))
        return np.bincount(word, total, len(col))

    def learn(self, col: pa.Array, g2: np.ndarray) -> None:
        """Predicts, then learns from, a few words at a time."""
        b, _, place = word_bytes(col)
        low = np.minimum(place, PLACES - 1)
        for live, bit, slots in bits(b, place, self.code):
            x, gate = self.learned(bit, slots, low[live])
            z = self.mixed(x, gate)
            self.seen += np.bincount(self.cell(z, low[live]) * 2 + bit, minlength=len(self.seen))
            err = bit - sigmoid(z)
            n = self.weights.shape[1]
            g = np.stack([*[np.bincount(gate, err * x[i], n) for i in range(ORDERS)], 0.3 * np.bincount(gate, err, n)])
            g /= np.maximum(np.bincount(gate, minlength=n), 1)
            g2 += g * g
            self.weights += (0.05 * g / np.sqrt(g2)).astype(np.float32)


def _cut(col: pa.Array, n: int) -> Iterator[pa.Array]:
    for i in range(0, len(col), n):
        yield col.slice(i, n)


def _summed(df: DataFrame, label: str) -> np.ndarray:
    """Sum of the arrays that tasks emitted as rows (chunk, data); their size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for c, d in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
                v = np.frombuffer(d, np.float64 if len(d) < 8 * CHUNK else np.float32).astype(np.float64)
                acc[c] = acc[c] + v if c in acc else v
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())],
                                             ["chunk", "data"])

    rows = df.repartition("chunk").mapInArrow(add, "chunk int, data binary").collect()
    return {r["chunk"]: np.frombuffer(r["data"], np.float64) for r in rows}


def fit_speller(vocabulary: DataFrame) -> Speller:
    """Learns to spell from all words of ``vocabulary (words, n)`` that training texts hold, each counting once."""
    rows = vocabulary.select("words", "n")

    def known(b: pa.RecordBatch) -> Iterator[pa.Array]:
        for words, n in zip(b.column("words").to_pylist(), b.column("n").to_pylist()):
            w = unpack_words(words)
            use = np.flatnonzero(unpack_long(n))
            for i in range(0, len(use), 1 << 15):
                yield _strings(w, use[i:i + (1 << 15)])

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256)
        for b in batches:
            for part in known(b):
                n += np.bincount(word_bytes(part)[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n)], ["b", "n"])

    seen = np.zeros(256)
    for r in rows.mapInArrow(count_bytes, "b int, n double").groupBy("b").agg(F.sum("n").alias("n")).collect():
        seen[r["b"]] = r["n"]
    code = huffman(seen)

    def count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, some = np.zeros(2 * SLOTS, np.float32), False
        for b in batches:
            held, many = [], 0
            for part in known(b):
                raw, _, place = word_bytes(part)
                for _, bit, slots in bits(raw, place, code):
                    some = True
                    held.append((slots * 2 + bit).astype(np.int32).ravel())
                    many += held[-1].size
                    if many > 1 << 22:
                        n += np.bincount(np.concatenate(held), minlength=2 * SLOTS)
                        held, many = [], 0
            if held:
                n += np.bincount(np.concatenate(held), minlength=2 * SLOTS)
        if some:
            parts = n.reshape(-1, 2 * CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                             ["chunk", "data"])

    table = np.zeros((2 * SLOTS // (2 * CHUNK), 2 * CHUNK), np.float32)
    for c, v in _summed(rows.mapInArrow(count_bits, "chunk int, data binary"), "bits").items():
        table[c] = v
    table = table.reshape(-1, 2)
    zero, one = table[:, 0].copy(), table[:, 1].copy()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = Speller(code, zero, one), 0
        g2 = np.full(s.weights.shape, 1e-4)
        for b in batches:
            for words in known(b):
                for part in _cut(words, 2048):
                    s.learn(part, g2)
                    n += len(part)
        if n:
            out = [np.array([float(n)]), s.weights.ravel() * n, s.seen.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), pa.array([x.astype(np.float64).tobytes() for x in out], pa.binary())],
                                             ["chunk", "data"])

    got = _summed(rows.mapInArrow(learn, "chunk int, data binary"), "mixer")
    s = Speller(code, zero, one)
    if got:
        s.weights = (got[1] / got[0][0]).reshape(s.weights.shape).astype(np.float32)
        s.seen = got[2].copy()
    return s


# --- blocks and counts ---------------------------------------------------------------------
#
# Texts, words and counts travel in compressed cells of some megabytes, not in a row each.

BLOCK_BYTES, CELL_BYTES = 16 << 20, 4 << 20      # text of a block, and of one of its cells


def pack(x: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending 64-bit numbers."""
    d = np.diff(h, prepend=np.uint64(0))
    return pack(np.concatenate([d & np.uint64(0xFFFFFFFF), d >> np.uint64(32)]))


def unpack_hashes(b: bytes) -> np.ndarray:
    d = unpack(b).astype(np.uint64)
    n = len(d) // 2
    return np.cumsum(d[:n] | (d[n:] << np.uint64(32)))


def pack_long(x: np.ndarray) -> bytes:
    """64-bit numbers from 0 on."""
    x = x.astype(np.uint64)
    return pack(np.concatenate([x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)]))


def unpack_long(b: bytes) -> np.ndarray:
    d = unpack(b).astype(np.int64)
    n = len(d) // 2
    return d[:n] | (d[n:] << 32)


def unpack_words(b: bytes) -> common.Words:
    """Words of a cell, as cut from one text."""
    off, data = np.zeros(2, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    off[1] = len(data)
    return common.cut_words(off, data, 0, 1, common.NOT_SPACE, lower=False)


def _strings(w: common.Words, which: np.ndarray) -> pa.Array:
    """Some words as a string array."""
    size = (w.end - w.start)[which]
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat(w.start[which] - off[:-1], size) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(off.tobytes()), pa.py_buffer(w.buf[at].tobytes()))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents gathered into cells, and cells into blocks that one task has read."""
    block, filled = TaskContext.get().partitionId() << 24, 0
    for b in batches:
        off, _ = common.text_bytes(b.column("text"))
        for i, j in common.slices(off, CELL_BYTES):
            size = int(off[j] - off[i])
            if filled and filled + size > BLOCK_BYTES:
                block, filled = block + 1, 0
            filled += size
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_batch(b.slice(i, j - i))
            train = int((~np.asarray(b.column("held_out"))[i:j]).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([size]), pa.array([train]), pa.array([out.getvalue().to_pybytes()], pa.binary())],
                ["block", "bytes", "train", "docs"])


def documents(cell: bytes) -> pa.RecordBatch:
    t = pa.ipc.open_stream(cell).read_all().combine_chunks()
    return t.to_batches()[0]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of cells of one block."""
    rows = ((k, c) for b in batches for k, c in zip(b.column("block").to_pylist(), b.column("docs").to_pylist()))
    for block, cells in groupby(rows, key=lambda r: r[0]):
        yield block, (documents(c) for _, c in cells)


def _block_words(bits: int):
    """Per block and bucket the distinct words, ascending by hash, and the times training texts of the block hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cells in _by_block(batches):
            hs, ss, ns = [], [], []
            for d in cells:
                off, data = common.text_bytes(d.column("text"))
                train = (~np.asarray(d.column("held_out"))).astype(np.int64)
                w = common.cut_words(off, data, 0, len(d), common.NOT_SPACE)
                h, one, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                hs.append(h)
                ss.append(_strings(w, one))
                ns.append(np.bincount(inv, train[w.doc], len(h)))
            h, one, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
            if not len(h):
                continue
            n = np.bincount(inv, np.concatenate(ns), len(h)).astype(np.int64)
            words = pa.concat_arrays(ss).take(pa.array(one))
            bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(at[1:], len(h))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), words), "\n")
            zip_ = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), pa.array(bucket[at]), pa.array([zip_.compress(x.encode()) for x in joined.to_pylist()], pa.binary()),
                 pa.array([pack(n[i:j]) for i, j in zip(at.tolist(), ends.tolist())], pa.binary())], ["block", "bucket", "words", "n"])

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket: the bucket's vocabulary with its counts, and figures of it."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "words", "n"))))
    for bucket, part in groupby(rows, key=lambda r: r[0]):
        hs, ss, ns = [], [], []
        for _, words, n in part:
            w = unpack_words(words)
            hs.append(w.hash)
            ss.append(_strings(w, np.arange(len(w.hash))))
            ns.append(unpack(n))
        h, one, inv = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        c = np.bincount(inv, np.concatenate(ns), len(h)).astype(np.int64)
        words = zstandard.ZstdCompressor(level=3).compress("\n".join(pa.concat_arrays(ss).take(pa.array(one)).to_pylist()).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (bucket, words, pack_long(c), int(c.sum()), int((c > 0).sum()), int((c == 1).sum()), int((c == 2).sum()))],
            ["bucket", "words", "n", "tokens", "types", "once", "twice"])


def _answer_words(speller: Speller, totals: Totals):
    """Rows arrive sorted by bucket, the vocabulary first: each block's words with count and probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            for bucket, block, words, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "words", "n"))):
                w = unpack_words(words)
                if block < 0:
                    c = unpack_long(n)
                    lp = np.concatenate([speller.log10(_strings(w, x)) for x in np.array_split(np.arange(len(c)), len(c) // (1 << 15) + 1)])
                    o = np.argsort(w.hash)
                    table = w.hash[o], c[o], np.round(-UNITS * totals.log10(c, lp)[o])
                    continue
                at = np.searchsorted(table[0], w.hash)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([bucket]), pa.array([pack_hashes(w.hash)], pa.binary()), pa.array([pack_long(table[1][at])], pa.binary()),
                     pa.array([pack_long(table[2][at])], pa.binary())], ["block", "bucket", "keys", "n", "lp"])

    return run


UNITS = 4096.0       # a word's log10 probability travels in such steps


@dataclass
class Totals:
    tokens: int          # training tokens, ends included
    types: int           # distinct ones
    ends: int            # training texts
    discount: float

    def log10(self, c: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """log10 of the interpolated probability of words."""
        if not self.tokens:
            return np.log10(0.5) + spelled
        known = np.maximum(c - self.discount, 0) / self.tokens
        rest = self.discount * max(self.types - 1, 0) / self.tokens
        low = spelled + np.log10(max(rest, 1e-300))
        return np.where(c > 0, np.log10(np.maximum(known, 1e-300) + 10.0 ** np.maximum(low, -300)), low)

    def end(self) -> float:
        return float(np.log10(self.ends / self.tokens)) if self.tokens else float(np.log10(0.5))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
def pair_keys(w: common.Words, bits: int) -> np.ndarray:
    """Key of (word before, token) for every token, the end of each text included; text after text."""
    n = w.per_doc()
    place = np.arange(len(w.doc)) + w.doc
    size = len(w.doc) + w.n_docs
    now, before = np.full(size, END), np.full(size, START)
    now[place] = w.hash
    before[place + 1] = w.hash
    before[np.cumsum(n + 1) - n - 1] = START
    return common.mix64(before * np.uint64(3) + now) >> np.uint64(32 - bits)


def _block_pairs(bits: int):
    """Each block's distinct pairs by bucket: keys, training occurrences, whether a held-out text of the block has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cells in _by_block(batches):
            ks, ns = [], []
            for d in cells:
                off, data = common.text_bytes(d.column("text"))
                train = (~np.asarray(d.column("held_out"))).astype(np.int64)
                w = common.cut_words(off, data, 0, len(d), common.NOT_SPACE)
                # Training occurrences count 2, held-out ones set the last bit.
                k, inv = np.unique(pair_keys(w, bits), return_inverse=True)
                t = np.repeat(train, w.per_doc() + 1)
                n = np.bincount(inv, t, len(k)).astype(np.int64)
                ks.append(k)
                ns.append((2 * n + (np.bincount(inv, minlength=len(k)) > n)).astype(np.uint32))
            k, n = np.concatenate(ks), np.concatenate(ns)
            o = np.argsort(k)
            k, n = k[o], n[o]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            count, held = np.add.reduceat(n >> 1, first), np.bitwise_or.reduceat(n & 1, first)
            k = k[first]
            bucket = (k >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            cut = list(zip(at.tolist(), [*at[1:].tolist(), len(k)]))
            low = (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), pa.array(bucket[at]), pa.array([pack(np.diff(low[i:j], prepend=0)) for i, j in cut], pa.binary()),
                 pa.array([pack(count[i:j]) for i, j in cut], pa.binary()), pa.array([pack(held[i:j]) for i, j in cut], pa.binary())],
                ["block", "bucket", "keys", "n", "held"])

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket. Each block gets the counts of its pairs, as far as they can tell it anything:
    a pair that only one training text holds says nothing about that text."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "keys", "n", "held"))))
    for bucket, part in groupby(rows, key=lambda r: r[0]):
        part = list(part)
        keys = [np.cumsum(unpack(r[2]), dtype=np.uint64).astype(np.uint32) for r in part]
        own = np.concatenate([unpack(r[3]) for r in part])
        k = np.concatenate(keys)
        o = np.argsort(k, kind="stable")
        first = np.flatnonzero(np.append(True, k[o][1:] != k[o][:-1]))
        total = np.empty(len(k), np.int64)
        total[o] = np.repeat(np.add.reduceat(own[o].astype(np.int64), first), np.diff(np.append(first, len(k))))
        res, at = [], 0
        for (_, block, _, _, held), x in zip(part, keys):
            c = total[at:at + len(x)]
            use = (c > 1) | ((c > 0) & (unpack(held) > 0))
            at += len(x)
            res.append((block, bucket, pack(np.diff(x[use].astype(np.int64), prepend=0)), pack_long(c[use])))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*res), kinds)], ["block", "bucket", "keys", "n"])


# --- mixing inside a text ------------------------------------------------------------------

def mix_text(p: np.ndarray, after: np.ndarray, gate: np.ndarray, earlier: np.ndarray, ctx: np.ndarray,
             length: np.ndarray) -> np.ndarray:
    """log10 probability of each text.

    Per token, text after text: ``p`` its probability by itself (0 is allowed where ``after`` or ``earlier`` is not), ``after`` that of
    following the word before, ``gate`` the power of two up to which that word occurs (0: never), ``earlier``
    the times the token came before in its text, ``ctx`` a byte hashed from the word before. Texts
    advance in step. Two mixers weigh ``after`` against ``p`` and the text's own words against
    both; each has predictors of what share it should take, which learn after each token, as do
    the mixer's gated weights.
    """
    out = np.zeros(len(length))
    if not len(p):
        return out
    f4 = np.float32
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    size = length[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")
    base = np.concatenate([[0], np.cumsum(active)])
    perm = np.empty(len(p), np.int32 if len(p) < 1 << 31 else np.int64)
    for t in range(steps):
        perm[base[t]:base[t + 1]] = first[:active[t]] + t
    p, after, earlier = p.astype(f4)[perm], after.astype(f4)[perm], earlier.astype(f4)[perm]
    gate, ctx = gate[perm], ctx[perm]
    m = len(length)
    rows, score = np.arange(m), np.zeros(m)
    # The text's own words: the text so far, whether the last token repeated, the word before.
    q0, q1, q2 = np.full(m, 0.05, f4), np.full(2 * m, 0.05, f4), np.full(m * 256, 0.05, f4)
    own_weight = np.full((steps.bit_length() + 1, 3, m), 0.35, f4)
    repeated = np.zeros(m, np.int64)
    # What follows the word before: words as frequent in this text, whether the last token followed.
    r0 = np.tile(np.where(np.arange(PAIR_GATES) > 8, 0.3, 0.1).astype(f4), m)
    r1 = np.full(3 * m, 0.2, f4)
    w0, w1 = np.full(m * PAIR_GATES, 0.5, f4), np.full(m * PAIR_GATES, 0.5, f4)
    followed = np.ones(m, np.int64)
    one, rate = f4(1), f4(TEXT_RATE)
    for t in range(steps):
        n, a, z = int(active[t]), int(base[t]), int(base[t + 1])
        r = rows[:n]
        at = r * PAIR_GATES + gate[a:z]
        st = followed[:n] * m + r
        b, plain = after[a:z], p[a:z]
        now0, now1, v0, v1 = r0[at], r1[st], w0[at], w1[at]
        x0, x1 = np.log(now0 / (one - now0)), np.log(now1 / (one - now1))
        trust_pair = one / (one + np.exp(-(v0 * x0 + v1 * x1)))
        trust_pair[gate[a:z] == 0] = 0
        part = trust_pair * b
        inner = part + (one - trust_pair) * plain
        part /= np.where(inner > 0, inner, one)
        if t:
            i1, i2 = repeated[:n] * m + r, r * 256 + ctx[a:z]
            x = np.empty((3, n), f4)
            x[0], x[1], x[2] = q0[:n], q1[i1], q2[i2]
            target = x.copy()
            x = np.log(x / (one - x))
            v = own_weight[t.bit_length()][:, :n]
            trust = one / (one + np.exp(-(v * x).sum(0)))
            share = trust * (earlier[a:z] / f4(t))
            total = share + (one - trust) * inner
            share /= total
            v += rate * (share - trust) * x
            target = np.clip(share, f4(0.002), f4(0.998)) - target
            slow = f4(1 / min(t + 8.0, 60))
            q0[:n] += target[0] * slow
            q1[i1] += target[1] * slow
            q2[i2] += target[2] * f4(0.1)
            repeated[:n] = share > 0.5
            score[:n] += np.log10(total)
            err = rate * (one - share) * (part - trust_pair)
        else:
            score[:n] = np.log10(inner)
            err = rate * (part - trust_pair)
        w0[at] = v0 + err * x0
        w1[at] = v1 + err * x1
        target = np.clip(part, f4(0.002), f4(0.998))
        r0[at] = now0 + (target - now0) * f4(0.08)
        r1[st] = now1 + (target - now1) * f4(0.08)
        followed[:n] = (part > 0.1).astype(np.int64) + (part > 0.9)
    out[order] = score
    return out


class BlockTable:
    """Counts of a block's words and pairs, gathered from its rows and sorted on first use."""

    def __init__(self) -> None:
        self.words: list = []
        self.pairs: list = []
        self.ready = False

    def add(self, kind: int, bucket: int, keys: bytes, n: bytes, lp: bytes) -> None:
        if kind == 0:
            self.words.append((unpack_hashes(keys), unpack_long(n), unpack_long(lp)))
        else:
            self.pairs.append((np.cumsum(unpack(keys), dtype=np.uint64) | np.uint64(bucket << 32), unpack_long(n)))

    def close(self) -> None:
        if self.ready:
            return
        self.ready = True
        self.h, self.c, lp = (np.concatenate(x) for x in zip(*sorted(self.words, key=lambda x: x[0][0]))) if self.words else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.lp = lp / -UNITS
        some = sorted((x for x in self.pairs if len(x[0])), key=lambda x: x[0][0])
        self.k, self.n = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.words, self.pairs = [], []

    def pair(self, keys: np.ndarray) -> np.ndarray:
        """Training occurrences of pairs (none when the block was told nothing of them)."""
        if not len(self.k):
            return np.zeros(len(keys), np.int64)
        u, inv = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.k, u), len(self.k) - 1)
        return np.where(self.k[at] == u, self.n[at], 0)[inv]


def _score(totals: Totals, bits: int):
    """Rows arrive sorted by block: its counts, then its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (
            "block", "kind", "bucket", "keys", "n", "lp", "docs"))))
        for _, part in groupby(rows, key=lambda r: r[0]):
            table, read = BlockTable(), []
            for _, kind, bucket, keys, n, lp, docs in part:
                if kind < 2:
                    table.add(kind, bucket, keys, n, lp)
                else:
                    table.close()
                    read.append(_look_up(documents(docs), table, totals, bits))
            if read:
                yield _mixed(read)

    return run


def _look_up(b: pa.RecordBatch, table: BlockTable, totals: Totals, bits: int) -> dict[str, np.ndarray]:
    """What the mixing of a cell's texts needs: figures per text, and per token (the end of the text is its last)."""
    off, data = common.text_bytes(b.column("text"))
    w = common.cut_words(off, data, 0, len(b), common.NOT_SPACE)
    u, inv = np.unique(w.hash, return_inverse=True)
    at = np.searchsorted(table.h, u)
    if len(u) and (at.max() >= len(table.h) or (table.h[at] != u).any()):
        raise ValueError("a word of the block came without its counts")
    c, lp = table.c[at][inv], table.lp[at][inv]
    words, m = w.per_doc(), len(b)
    # Times each token came before in its text: place among equal (text, word) pairs.
    pair = common.mix64(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    o = np.argsort(pair, kind="stable")
    new = np.ones(len(o), bool)
    new[1:] = pair[o][1:] != pair[o][:-1]
    start = np.flatnonzero(new)
    earlier = np.empty(len(o), np.int64)
    earlier[o] = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    place = np.arange(len(w.doc)) + w.doc
    size, heads = len(w.doc) + m, np.cumsum(words + 1) - words - 1
    alone, seen, ctx = np.full(size, totals.end()), np.zeros(size, np.int32), np.zeros(size, np.uint8)
    before = np.full(size, totals.ends)
    alone[place], seen[place] = lp, earlier
    ctx[place + 1] = (w.hash >> np.uint64(56)).astype(np.uint8)
    before[place + 1] = c
    ctx[heads], before[heads] = 0, totals.ends
    # A training text's own occurrence is taken out of both counts.
    mine = np.repeat(~np.asarray(b.column("held_out")), words + 1).astype(np.int64)
    both = np.maximum(table.pair(pair_keys(w, bits)) - mine, 0)
    before = np.maximum(before - mine, both)
    # A token that nothing else vouches for is mixed as 1, and its own log10 probability, of any size, added to the score.
    apart = (both == 0) & (seen == 0)
    text = np.repeat(np.arange(m), words + 1)
    return {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": words + 1,
            "n_known": np.bincount(w.doc, c > 0, m).astype(np.int64) + (totals.ends > 0),
            "base": np.bincount(w.doc, totals.base(c), m) + totals.base(np.array([totals.ends]))[0],
            "bytes": np.diff(off).astype(np.int64), "apart": np.bincount(text, np.where(apart, alone, 0), m),
            "p": np.where(apart, 1, 10.0 ** alone).astype(np.float32), "after": (both / np.maximum(before, 1)).astype(np.float32),
            "gate": np.minimum(np.log2(before + 1), PAIR_GATES - 1).astype(np.uint8), "seen": seen, "ctx": ctx}


def _mixed(cells: list[dict]) -> pa.RecordBatch:
    """The texts of a block, mixed together: long ones are rare, and all advance in step."""
    col = {k: (pa.concat_arrays([c.pop(k) for c in cells]) if k in ("doc_id", "held_out") else np.concatenate([c.pop(k) for c in cells]))
           for k in list(cells[0])}
    score = mix_text(col["p"], col["after"], col["gate"], col["seen"], col["ctx"], col["n_tokens"]) + col["apart"]
    return pa.RecordBatch.from_arrays(
        [col["doc_id"], col["held_out"], *[pa.array(x) for x in (col["n_tokens"], col["n_known"], col["base"], score, col["bytes"])]],
        ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])


def score(docs: DataFrame, folds: int = 5, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text of ``docs`` scored by a model of the texts outside fold ``held``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(common.fold(id_col, folds) == held, F.lit(False)).alias("held_out"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = common.stage(rows.mapInArrow(_cells, "block long, bytes long, train long, docs binary"), "op4-base")
    size, ends, blocks = base.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "train")], F.count_distinct("block")).first()
    bits = max(1, (size >> 23).bit_length())          # a bucket for 8 MB of text
    # Tasks follow the number of buckets (two each, since a task has to load the speller) and blocks, so none reads more as the corpus grows.
    by_bucket, by_block = 1 << (bits - 1), max(1, 2 * blocks)
    cells = base.select("block", "docs")
    asked = common.stage(cells.mapInArrow(_block_words(bits), "block long, bucket long, words binary, n binary"), "op4-words")
    vocabulary = common.stage(
        asked.select("bucket", "words", "n").repartition(by_bucket, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_merge_words, "bucket long, words binary, n binary, tokens long, types long, once long, twice long"), "op4-vocabulary")
    t = vocabulary.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice")]).first()
    discount = min(0.95, max(0.1, t[2] / (t[2] + 2 * t[3]))) if t[2] else 0.5
    totals = Totals(int(t[0]) + ends, int(t[1]) + (ends > 0), ends, discount)
    speller = fit_speller(vocabulary)
    answers = (vocabulary.select("bucket", F.lit(-1).cast("long").alias("block"), "words", "n")
               .unionByName(asked).repartition(by_bucket, "bucket").sortWithinPartitions("bucket", "block")
               .mapInArrow(_answer_words(speller, totals), "block long, bucket long, keys binary, n binary, lp binary"))
    pairs = (cells.mapInArrow(_block_pairs(bits), "block long, bucket long, keys binary, n binary, held binary")
             .repartition(by_bucket, "bucket").sortWithinPartitions("bucket")
             .mapInArrow(_count_pairs, "block long, bucket long, keys binary, n binary"))
    none = F.lit(None)
    no = {"bucket": none.cast("long"), "keys": none.cast("binary"), "n": none.cast("binary"), "lp": none.cast("binary"),
          "docs": none.cast("binary")}

    def kind(df: DataFrame, k: int, *given: str) -> DataFrame:
        return df.select("block", F.lit(k).alias("kind"), *[F.col(c) if c in given else v.alias(c) for c, v in no.items()])

    work = (kind(answers, 0, "bucket", "keys", "n", "lp").unionByName(kind(pairs, 1, "bucket", "keys", "n"))
            .unionByName(kind(base, 2, "docs")))
    out = (work.repartition(by_block, "block").sortWithinPartitions("block", "kind")
           .mapInArrow(_score(totals, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                                             "score double, n_bytes long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"),
                      "base_score", "score", (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1)))
                      .alias("bits_per_byte"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from those outside fold 1 of 5."""
    return score(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
