"""N-gram Jaccard self-join with Bayesian candidate pruning (operator 1).

Texts are sets of five-word shingles; two texts link when their Jaccard
similarity reaches 0.8. Texts with the same words form a class, which is joined
once, whatever its number of copies. MinHash signatures of the classes are cut
into bands; classes that agree in a band are candidates. A candidate's values are
compared a few at a time, and it is dropped as soon as the posterior probability
(uniform prior, binomial matches) of reaching the threshold falls below a
tolerance. Survivors are verified exactly on their shingle sets.

Work goes in units of bounded size: a band's bucket of many classes is cut into
chunks of bounded classes and bytes, and each pair of chunks is a unit of its own, so no bucket is one task's
and none is capped. Very long texts are cut into words a slice at a time and take a chunk each. Pairs live inside a unit (packed, a row per unit); what
leaves it is a row per class: its links and a local root. A pair is taken only in
the first band it agrees in, so every link counts once. Roots are merged by
contracting the graph until no edge is left.

Words: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A
text of one to four words has one shingle, all its words.

Defined results: null, empty and wordless texts are alone in their class and link
to nothing; a null id sorts after every id; rows that repeat are copies of each
other; an empty table gives no rows; extra columns pass through :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4                      # a pair at 0.8 misses all bands with probability 3e-6
HASHES = BANDS * ROWS
STEP, TOLERANCE = 8, 1e-5                # values compared at a time; least posterior
CHUNK = 1024                             # classes of a bucket that meet in one unit, per side
MOST_CHUNK = 1 << 14                     # two of them are told by 16 bits, also when one came out above its mean
UNIT_BYTES = 64 << 20                    # bytes of text of a unit, per side (a longer text is a side of its own)

_A = common.mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = common.mix64(_A + np.uint64(99))
_W = common.mix64(np.arange(1, N + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """After n compared values, the fewest matches that keep the posterior of J >= threshold above tolerance.

    With a uniform prior the posterior after m of n matches is P(Binomial(n + 1, threshold) <= m).
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingles(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle, in order (not distinct)."""
    n = w.per_doc()
    first = np.cumsum(n) - n
    if not len(w.start):
        return w.hash, w.doc
    h = np.zeros(len(w.hash), np.uint64)
    for k in range(min(N, len(h))):
        h[:len(h) - k] += w.hash[k:] * _W[k]
    left = n[w.doc] - (np.arange(len(h)) - first[w.doc])      # words from here to the end of the text
    use = left >= N
    short = np.flatnonzero((n > 0) & (n < N))
    for d in short.tolist():
        i = first[d]
        h[i] = np.add.reduce(w.hash[i:i + n[d]] * _W[:n[d]]) + np.uint64(n[d])
        use[i] = True
    return common.mix64(h[use]), w.doc[use]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, bytes, a 128-bit key of the word sequence, and the signature of every text."""
    for b in batches:
        off, data = common.text_bytes(b.column("text"))
        m = len(b)
        words, k1, k2 = np.zeros(m, np.int64), np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        sig = np.zeros((m, HASHES), np.uint32)
        for i, j in common.slices(off):
            w = common.cut_words(off, data, i, j)
            n = w.per_doc()
            words[i:j] = n
            some = np.flatnonzero(n)
            if not len(some):
                continue
            first = (np.cumsum(n) - n)
            place = (np.arange(len(w.hash)) - first[w.doc]).astype(np.uint64)
            starts = first[some]
            k1[i + some] = np.add.reduceat(common.mix64(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), starts)
            k2[i + some] = np.add.reduceat(common.mix64((w.hash ^ np.uint64(0xABCDEF)) * (place * np.uint64(2) + np.uint64(1))), starts)
            g, doc = shingles(w)
            at = np.searchsorted(doc, some)
            for h in range(HASHES):
                sig[i + some, h] = np.minimum.reduceat(((g * _A[h] + _B[h]) >> np.uint64(32)).astype(np.uint32), at)
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), b.column("doc_id"), pa.array(words), pa.array(np.diff(off)), pa.array(k1.view(np.int64)),
             pa.array(k2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
            ["row", "doc_id", "words", "bytes", "k1", "k2", "sig"])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band of each signature."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)
    for r in range(ROWS):
        h = common.mix64(h + s[:, :, r])
    return h


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = band_keys(_signatures(b.column("sig")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(b.column("row")), BANDS)), pa.array(np.repeat(np.asarray(b.column("bytes")), BANDS)),
             pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(k))), pa.array(k.ravel().view(np.int64))],
            ["row", "bytes", "band", "key"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows arrive sorted by ``keys``, the last group waits for the next batch."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = [np.asarray(t.column(c)) for c in keys]
        same = np.ones(len(t), bool)
        for c in k:
            same &= c == c[-1]
        cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _prune(sig: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray, band: int, least: np.ndarray):
    """Pairs that did not meet in an earlier band and survive the incremental comparison."""
    if band:
        fresh = ~(keys[i, :band] == keys[j, :band]).any(1)
        i, j = i[fresh], j[fresh]
    m = np.zeros(len(i), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(i):
            break
        m += (sig[i, n - STEP:n] == sig[j, n - STEP:n]).sum(1)
        ok = m >= least[n]
        i, j, m = i[ok], j[ok], m[ok]
    return i, j


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per unit with surviving pairs: its classes and the pairs, as 16-bit places among them."""
    least, task, made = least_matches(), TaskContext.get().partitionId() << 36, 0
    for t in _runs(batches, ["band", "key", "lo", "hi"]):
        band, key, lo, hi, side, row = (np.asarray(t.column(c)) for c in ("band", "key", "lo", "hi", "side", "row"))
        sig = _signatures(t.column("sig").combine_chunks())
        keys = band_keys(sig)
        new = np.ones(len(t), bool)
        new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        at = np.append(np.flatnonzero(new), len(t))
        out: list[tuple] = []
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            if z - a < 2:
                continue
            left = np.arange(a, z) if lo[a] == hi[a] else a + np.flatnonzero(side[a:z] == lo[a])
            right = left if lo[a] == hi[a] else a + np.flatnonzero(side[a:z] == hi[a])
            if not len(left) or not len(right):
                continue
            found_i, found_j = [], []
            for p in range(0, len(left), 256):
                i = np.repeat(np.arange(p, min(p + 256, len(left))), len(right))
                j = np.tile(np.arange(len(right)), min(256, len(left) - p))
                if lo[a] == hi[a]:
                    up = i < j
                    i, j = i[up], j[up]
                i, j = _prune(sig, keys, left[i], right[j], int(band[a]), least)
                found_i.append(i)
                found_j.append(j)
            i, j = np.concatenate(found_i), np.concatenate(found_j)
            if len(i):
                who, inv = np.unique(np.concatenate([i, j]), return_inverse=True)
                out.append((task + made, row[who].tolist(), inv.astype(np.uint16).tobytes()))
                made += 1
        if out:
            u, rows, pairs = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(pairs, pa.binary())],
                                             ["unit", "rows", "pairs"])


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each member's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    # Many pairs of few sets: count by products of blocks of the incidence matrix of shingles that two sets or more hold.
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[inv] > 1
    col = np.cumsum(count > 1)[inv] - 1
    who, col = who[use], col[use]
    total = np.zeros((len(sets), len(sets)), np.float32)
    o = np.argsort(col, kind="stable")
    who, col = who[o], col[o]
    width = 2048
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(sets), width), np.float32)
        m[who[a:z], col[a:z] - c] = 1
        total += m @ m.T
    return total[i, j].astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities inside each unit; a row per class with a link."""
    for t in _runs(batches, ["unit"]):
        unit, kind, row, size = (np.asarray(t.column(c)) for c in ("unit", "kind", "row", "size"))
        off, data = common.text_bytes(t.column("text"))
        rows_col, pairs_col = t.column("rows").combine_chunks(), t.column("pairs").combine_chunks()
        out: list[np.ndarray] = []
        at = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(t))
        for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
            if kind[a] != 0:
                raise ValueError("a unit came without its pairs")
            who = np.array(rows_col[a].as_py(), np.int64)             # ascending places of the unit, any order of rows
            pairs = np.frombuffer(pairs_col[a].as_py(), np.uint16).astype(np.int64)
            i, j = pairs[:len(pairs) // 2], pairs[len(pairs) // 2:]
            order = np.argsort(who, kind="stable")                    # texts come by row
            place = np.empty(len(who), np.int64)
            place[order] = np.arange(len(who))
            i, j = place[i], place[j]
            if z - a - 1 != len(who) or (row[a + 1:z] != who[order]).any():
                raise ValueError("a unit came without all its texts")
            sets: list[np.ndarray] = []
            for p, q in common.slices(off[a + 1:z + 1]):
                g, doc = shingles(common.cut_words(off, data, a + 1 + p, a + 1 + q))
                ends = np.searchsorted(doc, np.arange(q - p + 1))
                sets += [np.unique(g[ends[d]:ends[d + 1]]) for d in range(q - p)]
            n = np.array([len(s) for s in sets])
            both = _shared(sets, i, j)
            good = both >= THRESHOLD * (n[i] + n[j] - both) - 1e-9
            i, j = i[good], j[good]
            if not len(i):
                continue
            weight, ids = size[a + 1:z], row[a + 1:z]
            docs = np.bincount(i, weight[j], len(n)) + np.bincount(j, weight[i], len(n))
            classes = np.bincount(np.concatenate([i, j]), minlength=len(n))
            root = _local_roots(len(n), i, j)
            use = np.flatnonzero(classes)
            out.append(np.stack([ids[use], ids[root[use]], classes[use], docs[use].astype(np.int64)]))
        if out:
            r = np.concatenate(out, 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in r], ["row", "root", "classes", "docs"])


def components(edges: DataFrame, label: str = "op1") -> DataFrame:
    """``v, root`` for the vertices of ``edges (a, b)``: every vertex moves to its least neighbour,
    the graph of those is taken, and so on until no edge is left."""
    edges = common.stage(edges.where("a <> b").distinct(), f"{label}-edges0")
    total, level = None, 0
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = common.stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), f"{label}-step{level}")
        if total is None:
            total = step.select(F.col("a").alias("v"), F.col("p").alias("root"))
        else:
            total = (total.join(step, total["root"] == step["a"], "left")
                     .select("v", F.coalesce("p", "root").alias("root")))
        total = common.stage(total, f"{label}-total{level}")
        level += 1
        edges = common.stage(
            edges.join(step, "a").select(F.col("p").alias("x"), "b")
            .join(step.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{label}-edges{level}")
    return total if total is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a row number, its columns named ``c0``, ``c1``, ... (as written), and the result per row.

    Result: ``row, doc_id, class_id, copy_id, n_links, kept``. ``copy_id`` is the least id
    with the same words, ``class_id`` the least id reached over links, ``n_links``
    the number of other documents that are copies of this or link to it directly, ``kept``
    true for one row of each class.
    """
    if not 0 < chunk <= MOST_CHUNK:
        raise ValueError(f"a unit of two chunks is told by 16 bits: chunk is 1 to {MOST_CHUNK}")
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_col, text_col = (names[docs.columns.index(c)] for c in (id_col, text_col))
    base = common.stage(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "op1-base")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = common.stage(
        base.select("row", F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .mapInArrow(_measure, "row long, doc_id long, words long, bytes long, k1 long, k2 long, sig binary"), "op1-signatures")
    some = narrow.where("words > 0")
    # Null ids sort last: the flag comes first.
    name = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    classes = common.stage(some.groupBy("words", "k1", "k2").agg(F.min(name).alias("rep"), F.count(F.lit(1)).alias("size"))
                           .select("words", "k1", "k2", "rep", F.col("rep.row").alias("row"), "size"), "op1-classes")
    reps = narrow.select("row", "bytes", "sig").join(classes.select("row", "size"), "row")
    bands = reps.select("row", "bytes", "sig").mapInArrow(_bands, "row long, bytes long, band int, key long")
    bands = common.stage(bands, "op1-bands")
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("load")).where("n > 1")
    # A bucket is cut by classes and by bytes, whichever gives more chunks.
    k = F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / F.lit(chunk)), F.ceil(F.col("load") / F.lit(UNIT_BYTES)))).cast("int")
    units = (bands.join(buckets, ["band", "key"]).withColumn("k", k)
             .withColumn("side", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("row", "band", "key", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")))
    unit_key = ["band", "key", "lo", "hi"]
    met = (units.join(reps.select("row", "sig"), "row").repartition(*unit_key).sortWithinPartitions(*unit_key)
           .select(*unit_key, "side", "row", "sig"))
    pairs = common.stage(met.mapInArrow(_candidates, "unit long, rows array<long>, pairs binary"), "op1-pairs")
    members = (pairs.select("unit", F.explode("rows").alias("row")).join(classes.select("row", "size"), "row")
               .join(base.select("row", text.alias("text")), "row"))
    none = F.lit(None)
    work = (pairs.select("unit", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("size"),
                         none.cast("string").alias("text"), "rows", "pairs")
            .unionByName(members.select("unit", F.lit(1).alias("kind"), "row", "size", "text",
                                        none.cast("array<long>").alias("rows"), none.cast("binary").alias("pairs"))))
    links = common.stage(work.repartition("unit").sortWithinPartitions("unit", "kind", "row")
                         .mapInArrow(_verify, "row long, root long, classes long, docs long"), "op1-links")
    roots = components(links.select(F.col("row").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("row").agg(F.sum("docs").alias("docs"))
    full = (classes.join(counts, "row", "left").join(roots.withColumnRenamed("v", "row"), "row", "left")
            .withColumn("root", F.coalesce("root", "row")))
    best = full.groupBy("root").agg(F.min("rep").alias("best"))
    full = common.stage(full.join(best, "root").select(
        "words", "k1", "k2", F.col("rep.id").alias("copy_id"), F.col("best.id").alias("class_id"), F.col("best.row").alias("best_row"),
        (F.coalesce("docs", F.lit(0)) + F.col("size") - 1).alias("n_links")), "op1-full")
    rest = narrow.where("words = 0").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"),
                                            F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    result = (some.select("row", "doc_id", "words", "k1", "k2").join(full, ["words", "k1", "k2"])
              .select("row", "doc_id", "class_id", "copy_id", "n_links", (F.col("row") == F.col("best_row")).alias("kept"))
              .unionByName(rest))
    return base, result


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, all columns as they were."""
    base, result = join(docs, **options)
    gone = result.where("not kept").select("row")
    return base.join(gone, "row", "left_anti").drop("row").toDF(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against each other, five-word shingles, similarity 0.8 or more."""
    return join(common.read(spark, sf_dir, "documents").select("doc_id", "text"))[1].select(
        "doc_id", "class_id", "n_links", "copy_id", "kept")
