"""Windows over token streams: last-N context, seeded fixed-length training
windows with shifted targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TRAIN_SEED
from ..functions.numeric import md5_uniform
from ..functions.text import pieces
from .ordering import running_agg

#: Up to so many window pieces (a few dozen bytes each) are broadcast to the documents.
MAX_BROADCAST_PAIRS = 1_000_000


def conversation_context(conv: DataFrame, n: int, sep: str = "\n") -> DataFrame:
    """``conv_id, n_total, n_context, context``: the last ``n`` pieces of each
    conversation, its turns joined by ``sep`` (white space) in the order of ``turn``.

    No conversation is gathered: a piece always ends where white space follows
    something else, so a conversation is cut there into parts, each with the words
    of one turn and the white space before them (blank turns are part of that).
    Parts are counted from the end, and only the last that fill the context
    meet, at most ``n`` pieces of each.

    A null turn adds nothing; a conversation of no text has the prefix space alone;
    null ids are one conversation; turns that tie follow a hash of their text.
    """
    text = F.col("text")
    turns = conv.select(F.struct("conv_id").alias("conv"), "turn", F.xxhash64("text").alias("h"), "text",
                        F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)).cast("bigint").alias("filled"))
    turns = running_agg(turns, ["conv"], ["turn", "h"], "filled", "before")
    core = F.regexp_replace(text, r"(?U)\s+\z", "")
    head = F.struct((F.col("before") + 1).alias("part"), F.coalesce(F.concat(F.lit(sep), F.when(
        F.col("filled") == 1, core).otherwise(text)), F.lit("")).alias("s"))
    tail = F.struct((F.col("before") + 2).alias("part"), F.substring(text, F.length(core) + 1, F.length(text)).alias("s"))
    cuts = F.when((F.col("filled") == 1) & (F.length(core) < F.length(text)), F.array(head, tail)).otherwise(F.array(head))
    parts = (turns.select("conv", "before", "turn", "h", F.inline(cuts)).groupBy("conv", "part")
             .agg(F.sort_array(F.collect_list(F.struct("before", "turn", "h", "s"))).alias("_s")))
    s = F.array_join(F.transform("_s", lambda x: x["s"]), "")
    first = F.substring(s, len(sep) + 1, F.length(s))
    ps = F.when(F.col("part") == 1, pieces(first)).otherwise(pieces(s, add_prefix_space=False))
    parts = parts.select("conv", (-F.col("part")).alias("from_end"), ps.alias("ps"))
    parts = parts.select("conv", "from_end", F.size("ps").cast("bigint").alias("n"), _last("ps", F.lit(n)).alias("ps"))
    parts = running_agg(parts, ["conv"], ["from_end"], "n", "after")
    total = parts.groupBy("conv").agg(F.sum("n").alias("n_total"))
    kept = (parts.where(F.col("after") < n).select("conv", "from_end", _last("ps", F.lit(n) - F.col("after")).alias("ps"))
            .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct((-F.col("from_end")).alias("part"), "ps"))).alias("_p")))
    context = F.flatten(F.transform("_p", lambda x: x["ps"]))
    return total.join(kept, "conv").select("conv.conv_id", "n_total", F.size(context).cast("bigint").alias("n_context"),
                                           context.alias("context"))


def token_context(conv: DataFrame, n: int, encode, sep: str = "\n") -> DataFrame:
    """``conv_id, n_context, context``: the last ``n`` token ids of each conversation.

    ``encode`` makes a column of pieces a list of ids per vocabulary (:func:`~tokloom.operators.encode.encode_udf`). Every piece has
    an id at least, so the last ``n`` pieces hold the last ``n`` ids and nothing before them is encoded.
    """
    tail = conversation_context(conv, n, sep).select("conv_id", encode("context")[0].alias("_ids"))
    return tail.select("conv_id", _last("_ids", F.lit(n)).alias("context")).select(
        "conv_id", F.size("context").cast("bigint").alias("n_context"), "context")


def _last(arr: str, n) -> Column:
    """The last ``n`` elements of an array."""
    keep = F.least(F.size(arr), n.cast("int"))
    return F.when(keep > 0, F.slice(arr, -keep, keep)).otherwise(F.slice(arr, 1, 0))


def window_starts(spark: SparkSession, lo: int, n: int, steps: int, batch: int, block: int, seed: int = TRAIN_SEED,
                  start_step: int = 0, compat: bool = False) -> DataFrame:
    """``step, slot, w0``: where the windows of :func:`sample_windows` begin in a stream of ``n`` tokens from ``lo`` on."""
    if n < block + 1:
        raise ValueError(f"{n} tokens cannot fill a window of {block} and its target")
    n_starts = n - block - (1 if compat else 0)
    if n_starts <= 0:
        raise ValueError(f"no window start for {n} tokens and block {block}")
    w = spark.range(steps * batch).select(
        F.expr(f"id div {batch}").alias("step"), (F.col("id") % batch).alias("slot"))
    u = md5_uniform(seed + start_step, "step", "slot")
    return w.withColumn("w0", F.lit(lo) + F.floor(u * F.lit(n_starts)).cast("bigint"))


def sample_windows(tokens: DataFrame, steps: int, batch: int, block: int,
                   seed: int = TRAIN_SEED, start_step: int = 0, compat: bool = False,
                   chunk: int = 4096, ids: DataFrame | None = None, key: str = "start_pos",
                   span: tuple[int, int] | None = None) -> DataFrame:
    """Random fixed-length windows with replacement: ``step, slot, start_pos, x, y``
    with ``y`` = ``x`` shifted by one.

    ``tokens``: ``start_pos, n_tokens, ids`` of documents (or ``key, start_pos,
    n_tokens``, with ``key, ids`` in ``ids``) that follow each other without a gap, from any position on (a validation split starts where the
    training split ends). Starts are uniform over the valid range from md5
    uniforms of ``(seed + start_step, step, slot)``: every window start that
    leaves ``block + 1`` tokens (``compat=True`` never samples the last one). ``span``: first
    position and number of tokens of the whole stream, if ``tokens`` is a part of it that holds all windows.

    Windows and documents meet on the chunks of ``chunk`` positions that both
    touch; only documents that a window touches give up tokens, as slices. A
    window that comes out short (a gap in the stream) is an error.
    """
    spark = tokens.sparkSession
    if span is None:
        r = tokens.agg(F.min("start_pos").alias("lo"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()
        span = r["lo"], r["n"]
    w = window_starts(spark, *span, steps, batch, block, seed, start_step, compat)

    def chunks(start, end):
        return F.explode(F.sequence(F.floor(start / chunk), F.floor(end / chunk)))

    wc = w.withColumn("c", chunks(F.col("w0"), F.col("w0") + block))
    docs = tokens.where("n_tokens > 0").select(*dict.fromkeys([key, "start_pos", "n_tokens"]))
    dc = docs.withColumn("c", chunks(F.col("start_pos"), F.col("start_pos") + F.col("n_tokens") - 1))
    # A pair meets in every chunk they share; it counts in the first one.
    pair = (wc.join(dc, "c")
            .where((F.col("start_pos") <= F.col("w0") + block) & (F.col("start_pos") + F.col("n_tokens") > F.col("w0"))
                   & (F.col("c") == F.floor(F.greatest("w0", "start_pos") / chunk))))
    # Every document of a pair gives a token, so pairs are bounded by the tokens asked for.
    if steps * batch * (block + 1) <= MAX_BROADCAST_PAIRS:
        pair = F.broadcast(pair)
    part = (tokens if ids is None else ids).select(key, "ids").join(pair, key)
    a = F.greatest(F.col("w0") - F.col("start_pos"), F.lit(0))
    z = F.least(F.col("w0") + block + 1 - F.col("start_pos"), F.col("n_tokens"))
    part = part.select("step", "slot", "w0", "start_pos", F.slice("ids", (a + 1).cast("int"), (z - a).cast("int")).alias("p"))
    got = part.groupBy("step", "slot", "w0").agg(F.sort_array(F.collect_list(F.struct("start_pos", "p"))).alias("_p"))
    arr = F.flatten(F.transform("_p", lambda x: x["p"]))
    full = w.join(got, ["step", "slot", "w0"], "left").withColumn("_a", arr)
    full = full.withColumn("_a", F.when(F.size("_a") == block + 1, F.col("_a")).otherwise(
        F.raise_error(F.lit("a window lacks tokens"))))
    return full.select("step", "slot", F.col("w0").alias("start_pos"),
                       F.slice("_a", 1, block).alias("x"), F.slice("_a", 2, block).alias("y"))
