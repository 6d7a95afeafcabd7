"""Registered score-filter queries over ``embeddings`` read as score vectors.

Request = ``vec_id``; candidate = position in ``embedding`` (0-based);
the request's ``label`` is its prompt token, so it counts as seen. Settings
are the reference's sampling defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import TRAIN_SEED
from ..operators import scoring as S
from ..sources.tables import read_table

TEMPERATURE, TOP_K, TOP_P, PENALTY = 0.8, 40, 0.95, 1.15


def _scores(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    scores = S.scores_from_vectors(emb, "vec_id", "embedding")
    seen = emb.select(F.col("vec_id").alias("req_id"), F.col("label").cast("int").alias("token_id"))
    return S.apply_penalty(scores, seen, PENALTY)


def _scaled(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("scaled", F.col("penalised") / TEMPERATURE)


def q_penalised_scores(spark, sf_dir):
    p = _scores(spark, sf_dir)
    return p.select("req_id", "token_id", "seen", F.round("score", 6).alias("score"),
                    F.round("penalised", 6).alias("penalised"))


def q_greedy_pick(spark, sf_dir):
    g = S.greedy_pick(_scores(spark, sf_dir), "penalised")
    return g.select("req_id", "token_id", F.round("penalised", 6).alias("penalised"))


def q_topk_scores(spark, sf_dir):
    t = S.top_k(_scaled(spark, sf_dir), TOP_K)
    return t.select("req_id", "token_id", F.col("rank").cast("bigint").alias("rank"),
                    F.round("scaled", 6).alias("scaled"))


def q_softmax_scores(spark, sf_dir):
    s = S.softmax(S.top_k(_scaled(spark, sf_dir), TOP_K))
    return s.select("req_id", "token_id", F.round("prob", 9).alias("prob"))


def q_nucleus_scores(spark, sf_dir):
    s = S.top_p(S.softmax(S.top_k(_scaled(spark, sf_dir), TOP_K)), TOP_P)
    return s.select("req_id", "token_id", F.round("prob", 9).alias("prob"))


def q_weighted_draw(spark, sf_dir):
    s = S.top_p(S.softmax(S.top_k(_scaled(spark, sf_dir), TOP_K)), TOP_P)
    return S.weighted_draw(s, TRAIN_SEED)


QUERIES = {
    "penalised_scores": q_penalised_scores,
    "greedy_pick": q_greedy_pick,
    "topk_scores": q_topk_scores,
    "softmax_scores": q_softmax_scores,
    "nucleus_scores": q_nucleus_scores,
    "weighted_draw": q_weighted_draw,
}

SCORES_CTE = f"""
sc AS (
  SELECT vec_id AS req_id, CAST(i - 1 AS INTEGER) AS token_id,
         CAST(embedding[i] AS DOUBLE) AS score, label
  FROM (SELECT vec_id, embedding, label, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
pen AS (
  SELECT req_id, token_id, score, (token_id = label) AS seen,
         CASE WHEN token_id <> label THEN score
              WHEN score > 0 THEN score / {PENALTY} ELSE score * {PENALTY} END AS penalised
  FROM sc),
scl AS (SELECT *, penalised / {TEMPERATURE} AS scaled FROM pen),
tk AS (
  SELECT * FROM (SELECT *, rank() OVER (PARTITION BY req_id ORDER BY scaled DESC) AS rnk FROM scl)
  WHERE rnk <= {TOP_K}),
smx AS (
  SELECT *, exp(scaled - mx) AS e FROM (SELECT *, max(scaled) OVER (PARTITION BY req_id) AS mx FROM tk)),
smp AS (SELECT *, e / sum(e) OVER (PARTITION BY req_id) AS prob FROM smx),
nu AS (
  SELECT * FROM (
    SELECT *, sum(prob) OVER (PARTITION BY req_id ORDER BY prob DESC, token_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
    FROM smp) WHERE cum - prob < {TOP_P}),
nup AS (SELECT req_id, token_id, prob / sum(prob) OVER (PARTITION BY req_id) AS prob FROM nu)"""

ORACLE = {
    "penalised_scores": f"""
WITH {SCORES_CTE}
SELECT req_id, token_id, seen, round(score, 6) AS score, round(penalised, 6) AS penalised FROM pen""",

    "greedy_pick": f"""
WITH {SCORES_CTE}
SELECT req_id, token_id, round(penalised, 6) AS penalised FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY penalised DESC, token_id) AS rn FROM pen)
WHERE rn = 1""",

    "topk_scores": f"""
WITH {SCORES_CTE}
SELECT req_id, token_id, CAST(rnk AS BIGINT) AS rank, round(scaled, 6) AS scaled FROM tk""",

    "softmax_scores": f"""
WITH {SCORES_CTE}
SELECT req_id, token_id, round(prob, 9) AS prob FROM smp""",

    "nucleus_scores": f"""
WITH {SCORES_CTE}
SELECT req_id, token_id, round(prob, 9) AS prob FROM nup""",

    "weighted_draw": f"""
WITH {SCORES_CTE},
g AS (
  SELECT req_id, token_id,
         ln(prob + 1e-10) - ln(-ln((CAST(('0x' || substr(md5(concat_ws('|', '{TRAIN_SEED}',
            CAST(req_id AS VARCHAR), CAST(token_id AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5)
            / 4503599627370496.0)) AS key
  FROM nup)
SELECT req_id, token_id FROM (
  SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY key DESC, token_id) AS rn FROM g)
WHERE rn = 1""",
}
