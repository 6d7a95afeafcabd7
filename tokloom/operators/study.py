"""Vocabulary study: fertility, probe-word splits, words per context, bytes and
characters per token, held-out loss of a count model, bits per byte and per
character, parameter counts, winners; and the model-size scaling table.

Everything is per vocabulary and joined on ``vocab``; the per-vocabulary
tables are tiny, the work is in the token tables they summarise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import text as T
from ..functions.constants import CONFIGS, CONTEXT_TOKENS, ROPE_BASE_DEFAULT
from ..functions.numeric import embed_params, model_params
from ..session import staged
from .merging import summed

CONFIG_SCHEMA = Ty.StructType([
    Ty.StructField("name", Ty.StringType()),
    Ty.StructField("n_layers", Ty.IntegerType()),
    Ty.StructField("n_heads", Ty.IntegerType()),
    Ty.StructField("n_embd", Ty.IntegerType()),
    Ty.StructField("block_size", Ty.IntegerType()),
    Ty.StructField("vocab_size", Ty.IntegerType()),
    Ty.StructField("batch_size", Ty.IntegerType()),
    Ty.StructField("max_steps", Ty.IntegerType()),
    Ty.StructField("learning_rate", Ty.DoubleType()),
    Ty.StructField("warmup_steps", Ty.IntegerType()),
    Ty.StructField("eval_every", Ty.IntegerType()),
    Ty.StructField("eval_batches", Ty.IntegerType()),
    Ty.StructField("checkpoint_every", Ty.IntegerType()),
    Ty.StructField("rope_base", Ty.IntegerType()),
])


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """Model configurations from JSON files: a fixed schema (unknown keys are
    ignored) and defaults for missing keys. A missing path raises."""
    df = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    return df.withColumn("rope_base", F.coalesce("rope_base", F.lit(ROPE_BASE_DEFAULT)))


def configs_table(spark: SparkSession) -> DataFrame:
    """The five configurations shipped with the reference, as a table."""
    rows = [tuple(c) + (ROPE_BASE_DEFAULT,) for c in CONFIGS]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def with_model_params(cfg: DataFrame, vocab_col: str = "vocab_size") -> DataFrame:
    """Add ``params``, ``embed_params``, ``embed_share``, ``valid`` (width divisible
    by heads), ``tokens_per_step`` and ``scaled_lr_384`` (learning rate expected
    from the 1/sqrt(width) rule at base width 384 and 6e-4)."""
    p = model_params(F.col(vocab_col), F.col("n_layers"), F.col("n_embd"))
    e = embed_params(F.col(vocab_col), F.col("n_embd"))
    return (cfg.withColumn("params", p).withColumn("embed_params", e)
            .withColumn("embed_share", F.col("embed_params") / F.col("params"))
            .withColumn("valid", F.col("n_embd") % F.col("n_heads") == 0)
            .withColumn("tokens_per_step", (F.col("batch_size") * F.col("block_size")).cast("bigint"))
            .withColumn("scaled_lr_384", F.lit(6e-4) * F.sqrt(F.lit(384.0) / F.col("n_embd"))))


def study_grid(configs: DataFrame, vocabs: DataFrame, steps: int, eval_every: int = 500,
               checkpoint_every: int = 1000) -> DataFrame:
    """One configuration per vocabulary: the architecture named in ``vocabs.arch``
    with vocabulary, name and step overrides (equi-join on the name)."""
    base = configs.drop("vocab_size").withColumnRenamed("name", "arch")
    g = vocabs.join(base, "arch")
    return (g.withColumn("vocab_size", F.col("vocab").cast("int"))
            .withColumn("name", F.concat(F.lit("vocab"), F.col("vocab").cast("string")))
            .withColumn("max_steps", F.lit(steps)).withColumn("eval_every", F.lit(eval_every))
            .withColumn("checkpoint_every", F.lit(checkpoint_every)))


def fertility(docs_tokens: DataFrame) -> DataFrame:
    """Tokens per whitespace word over the whole corpus.

    ``docs_tokens``: ``vocab, n_tokens, n_words``, a row per document and vocabulary.
    """
    return docs_tokens.groupBy("vocab").agg(
        (F.sum("n_tokens") / F.greatest(F.sum("n_words"), F.lit(1))).alias("fertility"),
        F.count(F.lit(1)).alias("sample_docs"))


def probe_stats(probe_tokens: DataFrame) -> DataFrame:
    """Per vocabulary: mean pieces per probe word (``tokens_per_compound``)."""
    return probe_tokens.groupBy("vocab").agg(F.avg("n_tokens").alias("tokens_per_compound"))


def words_per_context(text_tokens: DataFrame, text_col: str = "text",
                      context: int = CONTEXT_TOKENS) -> DataFrame:
    """``context * words / tokens`` per row (``words_per_256``)."""
    return text_tokens.withColumn(
        "words_per_256", F.lit(float(context)) * T.whitespace_words(text_col)
        / F.greatest(F.col("n_tokens"), F.lit(1)))


#: Pairs of ids that a task turns into keys and counts at a time, and sums of them that it holds (half as many again before they
#: are summed with each other).
COUNTED_PAIRS, HELD_SUMS = 1 << 21, 1 << 22
#: Rows of the batches in which a task gives its sums.
SUM_ROWS = 1 << 18


def _neighbour_keys(ids: np.ndarray, first: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """``at, end, keys`` of the pairs of ``ids[at:end]`` with the ids before them: (previous id + 1) * 2^32 + id,
    where 0 stands for the previous id at the places ``first``; at most ``most`` at a time."""
    for at in range(0, len(ids), most):
        end = min(at + most, len(ids))
        before = np.zeros(end - at, np.int64)
        before[1 if at == 0 else 0:] = ids[max(at - 1, 0):end - 1]
        before += 1
        lo, hi = np.searchsorted(first, [at, end])
        before[first[lo:hi] - at] = 0
        yield at, end, (before << 32) | ids[at:end]


#: Bits of the filter of asked pairs. More pairs than bits let others pass too, which costs rows and changes no count.
ASKED_BITS = 1 << 27


def _bits(keys: np.ndarray, vocab: int, n: int) -> np.ndarray:
    """The bit of each pair in a filter of ``n`` bits."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(vocab * 0xC2B2AE3D27D4EB4F % (1 << 64))
    return (mixed >> np.uint64(32)).astype(np.int64) % n


def asked_pairs(pairs: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds the pairs of ``vocab, prv, nxt`` (and may take others for them), as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vocab, prv, nxt = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns)
            keys = ((prv + 1) << 32) | nxt
            bit = np.unique(np.concatenate([np.zeros(0, np.int64), *(_bits(keys[vocab == v], int(v), ASKED_BITS) for v in np.unique(vocab))]))
            first = np.flatnonzero(np.concatenate([[True], bit[1:] >> 6 != bit[:-1] >> 6])) if len(bit) else bit
            words = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
            bits = np.bitwise_or.reduceat(words, first) if len(bit) else words
            yield pa.RecordBatch.from_arrays([pa.array(bit[first] >> 6), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = (pairs.where(F.col("prv").isNotNull()).select("vocab", "prv", "nxt").mapInArrow(run, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(ASKED_BITS >> 6, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _neighbour_rows(tokens: DataFrame, asked: np.ndarray | None) -> DataFrame:
    """``vocab, split, prv, nxt, c``: the pairs of :func:`neighbour_counts`, summed inside tasks over a bounded
    number of them at a time, so that a task gives far fewer rows than it has ids."""
    held_filter = None if asked is None else tokens.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}      # (vocab, split) -> keys and their sums
        single: dict[tuple, list[np.ndarray]] = {}                       # (vocab, split) -> sums by previous id + 1 and by id
        n_held, words = 0, None if held_filter is None else held_filter.value

        def sum_held() -> None:
            for group, parts in held.items():
                if len(parts) > 1:
                    held[group] = [summed(*(np.concatenate(x) for x in zip(*parts)))]

        def rows(group: tuple, prv: np.ndarray, nxt: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Batches of sums; an id below 0 is null."""
            for i in range(0, len(c), SUM_ROWS):
                p, q, some = prv[i:i + SUM_ROWS].astype(np.int32), nxt[i:i + SUM_ROWS].astype(np.int32), c[i:i + SUM_ROWS]
                same = pa.array(np.zeros(len(some), np.int8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]], pa.int32()).take(same), pa.array([group[1]], pa.string()).take(same),
                     pa.array(p, mask=p < 0), pa.array(q, mask=q < 0), pa.array(some)], ["vocab", "split", "prv", "nxt", "c"])

        def given() -> Iterator[pa.RecordBatch]:
            for group, parts in held.items():
                for key, c in parts:
                    yield from rows(group, (key >> 32) - 1, key & 0xFFFFFFFF, c)

        def add_single(group: tuple, keys: np.ndarray) -> None:
            for k, part in enumerate((keys >> 32, keys & 0xFFFFFFFF)):
                n, sums = np.bincount(part), single.setdefault(group, [np.zeros(0, np.int64)] * 2)
                n[:len(sums[k])] += sums[k][:len(n)]
                sums[k] = np.concatenate([n, sums[k][len(n):]])

        for b in batches:
            groups: dict[tuple, int] = {}
            code = np.array([groups.setdefault(k, len(groups)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int32)
            n = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            ids = b.column(2).flatten().to_numpy(zero_copy_only=False)
            for at, end, keys in _neighbour_keys(ids, (ends - n)[n > 0], COUNTED_PAIRS):
                of = code[np.searchsorted(ends, np.arange(at, end), "right")] if len(groups) > 1 else None
                for group, g in groups.items():
                    some = keys if of is None else keys[of == g]
                    if words is not None and len(some):
                        bit = _bits(some, group[0], 64 * len(words))
                        on = (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) != 0
                        add_single(group, some[~on])
                        some = some[on]
                    if not len(some):
                        continue
                    some = np.sort(some)
                    begin = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
                    held.setdefault(group, []).append((some[begin], np.diff(np.append(begin, len(some)))))
                    n_held += len(begin)
                if 2 * n_held >= 3 * HELD_SUMS:
                    sum_held()
                    n_held = sum(len(key) for parts in held.values() for key, _ in parts)
                    if n_held >= HELD_SUMS:
                        yield from given()
                        held.clear()
                        n_held = 0
        sum_held()
        yield from given()
        for group, (by_prv, by_nxt) in single.items():
            none = np.full(max(len(by_prv), len(by_nxt)), -1)
            i = np.flatnonzero(by_prv[1:]) + 1              # 0 stands for no previous id
            yield from rows(group, i - 1, none[:len(i)], by_prv[i])
            i = np.flatnonzero(by_nxt)
            yield from rows(group, none[:len(i)], i, by_nxt[i])

    return (tokens.where(F.size("ids") > 0).select(F.col("vocab").cast("int").alias("vocab"), "split", "ids")
            .mapInArrow(run, "vocab int, split string, prv int, nxt int, c long"))


def neighbour_counts(tokens: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """``vocab, split, prv, nxt, c``: every id with the one before it, counted; ``prv`` is null for a document's first.

    Ids are gone through once: counts of single ids are sums of these. With ``asked`` (:func:`asked_pairs`) only pairs that the
    filter holds get rows of their own. Every other place is counted in two rows, by the previous id (``nxt`` null) and by the id
    (``prv`` null), so that sums by ``prv`` and by ``nxt`` are what they are without it.
    """
    return _neighbour_rows(tokens, asked).groupBy("vocab", "split", "prv", "nxt").agg(F.sum("c").alias("c"))


def batch_losses(windows: DataFrame, counts: DataFrame, vocab: int) -> DataFrame:
    """``step, n_tokens, mean_loss``: evaluation batches (``step, x, y`` of :func:`~tokloom.operators.windows.sample_windows`) under
    the add-one count model of :func:`ngram_loss`; ``counts``: the training ``prv, nxt, c`` of the vocabulary.

    Equal pairs of a batch are summed before they meet their counts. Fixed seeds give the same batches, so evaluations compare.
    """
    pairs = (windows.select("step", F.explode(F.arrays_zip("x", "y")).alias("p"))
             .groupBy("step", F.col("p.x").alias("prv"), F.col("p.y").alias("nxt")).agg(F.count(F.lit(1)).alias("m")))
    bi = counts.where(F.col("prv").isNotNull())
    ctx = bi.groupBy("prv").agg(F.sum("c").alias("c1"))
    scored = pairs.join(bi.select("prv", "nxt", "c"), ["prv", "nxt"], "left").join(ctx, "prv", "left").withColumn(
        "nll", -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("c1", F.lit(0)) + F.lit(float(vocab)))))
    return scored.groupBy("step").agg(F.sum("m").alias("n_tokens"), (F.sum(F.col("nll") * F.col("m")) / F.sum("m")).alias("mean_loss"))


def ngram_loss(tokens: DataFrame, vocab_size_col: str = "vocab") -> DataFrame:
    """Held-out loss of add-one unigram and bigram count models (a stand-in for a
    trained network): ``vocab, unigram_loss, bigram_loss, n_val``.

    ``tokens``: ``vocab, split, ids`` per document. Neighbours are paired inside
    each array; validation pairs are counted first, so counts meet counts and a
    frequent id is one row, and the loss is their weighted mean. Training pairs that no validation pair asks for
    are counted by their ids alone, which is all that they add to the loss.
    """
    V = F.col(vocab_size_col).cast("double")
    val = staged(neighbour_counts(tokens.where(F.col("split") == "val")), "val-neighbours")
    train = staged(neighbour_counts(tokens.where(F.col("split") == "train"), asked_pairs(val)), "train-neighbours")

    def single(df, name):
        return df.where(F.col("nxt").isNotNull()).groupBy("vocab", F.col("nxt").alias("id")).agg(F.sum("c").alias(name))

    def pairs(df, name):
        return df.where(F.col("prv").isNotNull() & F.col("nxt").isNotNull()).select("vocab", "prv", "nxt", F.col("c").alias(name))

    n_train = train.where(F.col("nxt").isNotNull()).groupBy("vocab").agg(F.sum("c").alias("n_train"))
    vu = (single(val, "m").join(single(train, "c"), ["vocab", "id"], "left").join(n_train, "vocab")
          .withColumn("nll", -F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n_train") + V))))
    uni_loss = vu.groupBy("vocab").agg((F.sum(F.col("nll") * F.col("m")) / F.sum("m")).alias("unigram_loss"),
                                       F.sum("m").alias("n_val"))
    ctx = train.where(F.col("prv").isNotNull()).groupBy("vocab", "prv").agg(F.sum("c").alias("c1"))
    vb = (pairs(val, "m").join(pairs(train, "c2"), ["vocab", "prv", "nxt"], "left").join(ctx, ["vocab", "prv"], "left")
          .withColumn("nll", -F.log((F.coalesce("c2", F.lit(0)) + 1) / (F.coalesce("c1", F.lit(0)) + V))))
    bi_loss = vb.groupBy("vocab").agg((F.sum(F.col("nll") * F.col("m")) / F.sum("m")).alias("bigram_loss"))
    return uni_loss.join(bi_loss, "vocab", "left")


def heldout_loss(scored: DataFrame, scores_col: str, target_col: str) -> DataFrame:
    """Add ``nll``: the cross entropy of each scored token, log-sum-exp of its score
    vector less the score of its target (0-based). A null target is not scored."""
    top = F.array_max(scores_col)
    lse = top + F.log(F.aggregate(scores_col, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))
    return scored.withColumn("nll", lse - F.get(scores_col, F.col(target_col)).cast("double"))


def study_table(parts: dict[str, DataFrame]) -> DataFrame:
    """Assemble one row per vocabulary from the per-vocabulary tables in
    ``parts`` (all keyed by ``vocab``) and derive the bit measures.

    Needs: ``params`` (vocab, params, embed_params, embed_share), ``fertility``,
    ``probes`` (tokens_per_compound), ``sentence`` (words_per_256), ``sizes``
    (vocab, n_tokens, corpus_bytes, corpus_chars), ``loss`` (vocab, val_loss).
    """
    t = parts["params"]
    for k in ("fertility", "probes", "sentence", "sizes", "loss"):
        t = t.join(parts[k], "vocab")
    bpt = F.col("corpus_bytes") / F.col("n_tokens")
    cpt = F.col("corpus_chars") / F.col("n_tokens")
    bits = F.col("val_loss") / F.lit(math.log(2))
    return t.select(
        "vocab", "params", "embed_params", "embed_share", "fertility", "tokens_per_compound",
        "words_per_256", bpt.alias("bytes_per_token"), cpt.alias("chars_per_token"), "val_loss",
        (bits / bpt).alias("bits_per_byte"), (bits / cpt).alias("bits_per_char"),
        F.log(F.col("vocab").cast("double")).alias("uniform_loss"))


def study_winners(study: DataFrame) -> DataFrame:
    """Lowest held-out loss against lowest bits per byte, and whether they
    disagree (one row)."""
    w = study.agg(
        F.min(F.struct("val_loss", "vocab"))["vocab"].alias("best_by_loss"),
        F.min(F.struct("bits_per_byte", "vocab"))["vocab"].alias("best_by_bits"))
    return w.withColumn("disagree", F.col("best_by_loss") != F.col("best_by_bits"))


def study_ranks(study: DataFrame) -> DataFrame:
    """Rank of each vocabulary by held-out loss and by bits per byte (the study
    table has one row per vocabulary, so the windows run over a handful of rows)."""
    w1, w2 = Window.orderBy("val_loss", "vocab"), Window.orderBy("bits_per_byte", "vocab")
    return study.select("vocab", F.row_number().over(w1).alias("loss_rank"),
                        F.row_number().over(w2).alias("bits_rank"))


def scaling_table(points: DataFrame) -> DataFrame:
    """``model, params, val_loss`` -> perplexity and, in order of size, the
    parameter ratio and loss change against the next smaller model. The table
    has one row per model (a handful), so the window is over a tiny input."""
    w = Window.orderBy("params")
    return points.select(
        "model", "params", "val_loss", F.exp("val_loss").alias("perplexity"),
        (F.col("params") / F.lag("params").over(w)).alias("param_ratio"),
        (F.lag("val_loss").over(w) - F.col("val_loss")).alias("loss_drop"))
