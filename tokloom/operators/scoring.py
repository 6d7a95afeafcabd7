"""Score filters of next-token sampling, as batch operators on score tables.

A score table is long form ``req_id, token_id, score`` (one row per request
and candidate). Every window is partitioned by request, so a group is one
request's candidates: bounded by the vocabulary width (< 65,536).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import DRAW_EPSILON, TRAIN_SEED
from ..functions.numeric import md5_uniform


def scores_from_vectors(vectors: DataFrame, req_col: str, vec_col: str) -> DataFrame:
    """Long form from an ``ARRAY<FLOAT>`` per request: token id = 0-based position."""
    return vectors.select(F.col(req_col).alias("req_id"),
                          F.posexplode(vec_col).alias("token_id", "score")).select(
        "req_id", F.col("token_id").cast("int").alias("token_id"),
        F.col("score").cast("double").alias("score"))


def apply_penalty(scores: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Push seen tokens down: positive scores divided, others multiplied.

    ``seen``: ``req_id, token_id`` (duplicates allowed). Adds ``seen`` and
    ``penalised``; ``penalty == 1`` leaves scores unchanged.
    """
    s = seen.select("req_id", "token_id").distinct().withColumn("_seen", F.lit(True))
    j = scores.join(s, ["req_id", "token_id"], "left")
    is_seen = F.coalesce(F.col("_seen"), F.lit(False))
    p = float(penalty)
    pen = (F.when(~is_seen | F.lit(p == 1.0), F.col("score"))
           .when(F.col("score") > 0, F.col("score") / p)
           .otherwise(F.col("score") * p))
    return j.withColumn("seen", is_seen).withColumn("penalised", pen).drop("_seen")


def greedy_pick(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """Arg-max per request; ties go to the smallest token id."""
    best = F.min(F.struct((-F.col(score_col)).alias("neg"), F.col("token_id").alias("tid")))
    return scores.groupBy("req_id").agg(best.alias("_b")).select(
        "req_id", F.col("_b.tid").alias("token_id"), (-F.col("_b.neg")).alias(score_col))


def top_k(scores: DataFrame, k: int, score_col: str = "scaled") -> DataFrame:
    """Keep scores not below the k-th largest (ties with it survive, so more than
    k rows may remain); ``k <= 0`` keeps everything. Adds ``rank``."""
    w = Window.partitionBy("req_id").orderBy(F.desc(score_col))
    r = scores.withColumn("rank", F.rank().over(w))
    return r if k <= 0 else r.where(F.col("rank") <= k)


def softmax(scores: DataFrame, score_col: str = "scaled", out_col: str = "prob") -> DataFrame:
    """Normalised exp(score - max) per request."""
    w = Window.partitionBy("req_id")
    e = F.exp(F.col(score_col) - F.max(score_col).over(w))
    return scores.withColumn("_e", e).withColumn(out_col, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_p(probs: DataFrame, p: float, prob_col: str = "prob") -> DataFrame:
    """Nucleus: in descending probability (ties by token id), keep while the
    cumulative sum before the row is below ``p`` (the first always stays),
    then renormalise. Active only for 0 < p < 1."""
    if not (0 < p < 1):
        return probs
    w = (Window.partitionBy("req_id").orderBy(F.desc(prob_col), "token_id")
         .rowsBetween(Window.unboundedPreceding, 0))
    kept = probs.withColumn("_cum", F.sum(prob_col).over(w)).where(
        F.col("_cum") - F.col(prob_col) < p)
    tot = F.sum(prob_col).over(Window.partitionBy("req_id"))
    return kept.withColumn(prob_col, F.col(prob_col) / tot).drop("_cum")


def weighted_draw(probs: DataFrame, seed: int = TRAIN_SEED, prob_col: str = "prob") -> DataFrame:
    """One categorical draw per request by Gumbel-max with md5 uniforms:
    argmax of ln(p + 1e-10) - ln(-ln u). Deterministic for a seed and
    independent of partitioning."""
    u = (md5_uniform(seed, "req_id", "token_id") * float(1 << 52) + 0.5) / float(1 << 52)
    key = F.log(F.col(prob_col) + DRAW_EPSILON) - F.log(-F.log(u))
    best = F.max(F.struct(key.alias("key"), (-F.col("token_id")).alias("neg_tid")))
    return probs.groupBy("req_id").agg(best.alias("_b")).select(
        "req_id", (-F.col("_b.neg_tid")).alias("token_id"))


def sample_next(scores: DataFrame, seen: DataFrame, temperature: float, k: int,
                p: float, penalty: float, seed: int = TRAIN_SEED) -> DataFrame:
    """The whole choice of one next token per request: penalty, then greedy when
    ``temperature <= 0``, else temperature, top-k, softmax, top-p and a draw."""
    pen = apply_penalty(scores, seen, penalty)
    if temperature <= 0:
        return greedy_pick(pen, "penalised").select("req_id", "token_id")
    scaled = pen.withColumn("scaled", F.col("penalised") / float(temperature))
    probs = top_p(softmax(top_k(scaled, k)), p)
    return weighted_draw(probs, seed)
