"""Registered streaming queries: each equals its batch form (checked against the
same DuckDB SQL the batch form would use)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import streams as S
from .corpus_oracle import batches_cte, labelled_cte
from .runs_plans import ORACLE as RUNS


def q_stream_run_summary(spark, sf_dir):
    r = S.stream_run_summary(spark, sf_dir)
    return r.select("run_id", "n_evals", F.round("best_val", 6).alias("best_val"),
                    F.round("worst_val", 6).alias("worst_val"),
                    F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"),
                    F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


def q_stream_corpus_filter(spark, sf_dir):
    return S.stream_corpus_filter(spark, sf_dir)


def _rates(df):
    return df.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     "event_type", "n", F.round("value_sum", 6).alias("value_sum"))


def q_stream_event_rates(spark, sf_dir):
    return _rates(S.stream_event_rates(spark, sf_dir, "1 hour"))


def q_stream_event_rates_sliding(spark, sf_dir):
    return _rates(S.stream_event_rates(spark, sf_dir, "2 hours", "1 hour"))


def q_stream_sessions(spark, sf_dir):
    s = S.stream_sessions(spark, sf_dir)
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "user_id", "n",
                    F.round("value_sum", 6).alias("value_sum"))


def q_stream_run_state(spark, sf_dir):
    rows, _ = S.stream_run_state(spark, sf_dir)
    return rows.select("run_id", "step", F.col("ema").cast("float").alias("ema"), F.round("best_so_far", 6).alias("best_so_far"))


def q_stream_corpus_offsets(spark, sf_dir):
    rows = S.corpus_places(*S.stream_corpus(spark, sf_dir))
    return rows.select("doc_id", "shard", "n_bytes", "start_byte", F.md5("doc").alias("doc_md5"))


QUERIES = {
    "stream_run_state": q_stream_run_state,
    "stream_corpus_offsets": q_stream_corpus_offsets,
    "stream_run_summary": q_stream_run_summary,
    "stream_corpus_filter": q_stream_corpus_filter,
    "stream_event_rates": q_stream_event_rates,
    "stream_event_rates_sliding": q_stream_event_rates_sliding,
    "stream_sessions": q_stream_sessions,
}

ORACLE = {
    "stream_run_state": f"""
SELECT a.run_id, a.step, a.ema, b.best_so_far FROM ({RUNS["loss_ema"]}) a JOIN ({RUNS["best_so_far"]}) b
  ON a.run_id IS NOT DISTINCT FROM b.run_id AND a.step = b.step""",

    "stream_corpus_offsets": f"""
WITH {batches_cte(dirtied=False)}
SELECT doc_id, shard, n_bytes, start_byte, md5(doc) AS doc_md5 FROM o""",

    "stream_run_summary": """
SELECT user_id AS run_id, count(*) AS n_evals, round(min(value), 6) AS best_val,
       round(max(value), 6) AS worst_val,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts
FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY user_id""",

    "stream_corpus_filter": f"""
WITH {labelled_cte(dirtied=False)}
SELECT doc_id, lang, n_chars, label FROM lab WHERE label <> 'empty'""",

    "stream_event_rates": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
       count(*) AS n, round(sum(value), 6) AS value_sum
FROM events GROUP BY 1, 2""",

    "stream_event_rates_sliding": """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
       round(sum(value), 6) AS value_sum
FROM (SELECT unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS w,
             event_type, value FROM events)
GROUP BY 1, 2""",

    # The watermark, a day behind the last event, has passed the sessions given.
    "stream_sessions": """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS first
           FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, user_id, count(*) AS n, round(sum(value), 6) AS value_sum
FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
}
