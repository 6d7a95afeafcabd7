"""Registered run-log queries (Spark side) and their DuckDB oracle SQL.

The run log is derived from ``events`` (see ``run_log_from_events``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CONFIGS
from ..operators import runs as R

# Schedule audited by ``lr_audit``: the nano configuration (learning rate and
# warmup); each run's last step is its planned total.
_NANO = next(c for c in CONFIGS if c[0] == "nano")
AUDIT_LR, AUDIT_WARMUP = _NANO[8], _NANO[9]


def _log(spark, sf_dir):
    return R.run_log_from_events(spark, sf_dir)


def q_run_summary(spark, sf_dir):
    return R.run_summary(_log(spark, sf_dir))


def q_loss_ema(spark, sf_dir):
    e = R.loss_ema(_log(spark, sf_dir), "val")
    # Single precision: decimal digits of two-decimal losses tie, binary ones do not.
    return e.select("run_id", "step", F.col("ema").cast("float").alias("ema"))


def q_best_so_far(spark, sf_dir):
    b = R.best_so_far(_log(spark, sf_dir), "val")
    return b.select("run_id", "step", F.round("best_so_far", 6).alias("best_so_far"))


def q_run_throughput(spark, sf_dir):
    return R.run_throughput(_log(spark, sf_dir))


def q_overfit_onset(spark, sf_dir):
    return R.overfit_onset(_log(spark, sf_dir))


def q_run_anomalies(spark, sf_dir):
    return R.run_anomalies(_log(spark, sf_dir))


def q_lr_audit(spark, sf_dir):
    return R.lr_audit(_log(spark, sf_dir), AUDIT_LR, AUDIT_WARMUP)


def q_loss_power_fit(spark, sf_dir):
    f = R.power_fit(_log(spark, sf_dir), "run_id", "step", "val")
    return f.select("run_id", F.round("exponent", 6).alias("exponent"),
                    F.round("log_c", 6).alias("log_c"), F.round("r2", 6).alias("r2"),
                    "n", "x_min", "x_max", "n_dropped")


def q_loss_fit_curve(spark, sf_dir):
    f = R.power_fit(_log(spark, sf_dir), "run_id", "step", "val")
    c = R.fit_curve(f, "run_id")
    return c.select("run_id", F.col("i").cast("bigint").alias("i"), F.round("x", 4).alias("x"),
                    F.round("y", 6).alias("y"))


def q_resumed_summary(spark, sf_dir):
    return R.resumed_summary(R.resumed_log_from_events(spark, sf_dir))


def q_resumed_throughput(spark, sf_dir):
    """Rates and remaining time over all sessions of resumed runs."""
    return R.run_throughput(R.continued(R.resumed_log_from_events(spark, sf_dir)))


QUERIES = {
    "resumed_summary": q_resumed_summary,
    "resumed_throughput": q_resumed_throughput,
    "run_summary": q_run_summary,
    "loss_ema": q_loss_ema,
    "best_so_far": q_best_so_far,
    "run_throughput": q_run_throughput,
    "overfit_onset": q_overfit_onset,
    "run_anomalies": q_run_anomalies,
    "lr_audit": q_lr_audit,
    "loss_power_fit": q_loss_power_fit,
    "loss_fit_curve": q_loss_fit_curve,
}

LOG_CTE = """
e AS (
  SELECT user_id AS run_id, event_id AS seq, ts, event_type, value AS val,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS train
  FROM events),
lg AS (
  SELECT run_id, seq, event_type, val, train,
         row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) AS k,
         10 * row_number() OVER (PARTITION BY run_id ORDER BY ts, seq) AS step,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id)) / 1e6 AS elapsed
  FROM e),
pv AS (
  SELECT *, lag(step) OVER w AS prev_step, lag(val) OVER w AS prev_val,
         lag(train) OVER w AS prev_train, lag(elapsed) OVER w AS prev_elapsed
  FROM lg WINDOW w AS (PARTITION BY run_id ORDER BY k))"""


RESUMED_CTE = LOG_CTE + """,
s0 AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY k
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM lg),
raw AS (SELECT run_id, k AS seq, 10 * greatest(k - 2 * coalesce(ended, 0), 1) AS step, train, val,
               elapsed - min(elapsed) OVER (PARTITION BY run_id, coalesce(ended, 0)) AS elapsed FROM s0),
fl AS (SELECT *, lag(elapsed) OVER (PARTITION BY run_id ORDER BY seq) AS was FROM raw),
ss AS (SELECT *, sum(CASE WHEN elapsed < was THEN 1 ELSE 0 END) OVER w AS session,
              elapsed + sum(CASE WHEN elapsed < was THEN was ELSE 0 END) OVER w AS wall
       FROM fl WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
ct AS (SELECT *, count(*) OVER (PARTITION BY run_id, step) AS n_logged FROM ss
       QUALIFY row_number() OVER (PARTITION BY run_id, step ORDER BY seq DESC) = 1)"""


def _lr(step: str, lr: float, warmup: int, max_steps: str) -> str:
    init, end = f"({lr} * 0.02)", f"({lr} * 0.1)"
    return (f"(CASE WHEN {step} < {warmup} THEN {init} + ({lr} - {init}) * least({step}, {warmup}) / {warmup} "
            f"ELSE {end} + 0.5 * (1 + cos(pi() / ({max_steps} - {warmup}) * "
            f"least({step} - {warmup}, {max_steps} - {warmup}))) * ({lr} - {end}) END)")


ORACLE = {
    "resumed_summary": f"""
WITH {RESUMED_CTE},
ls AS (SELECT run_id, max(session) AS last FROM ct GROUP BY run_id)
SELECT ct.run_id, CAST(max(session) + 1 AS BIGINT) AS n_sessions, CAST(sum(n_logged) AS BIGINT) AS n_logged, count(*) AS n_steps,
       (min(struct_pack(v := val, s := step)) FILTER (WHERE val IS NOT NULL)).s AS best_step, round(min(val), 6) AS best_val,
       round(min(val) FILTER (WHERE session = last), 6) AS best_of_last, round(max(wall), 3) AS wall,
       round(CASE WHEN max(wall) > 0 THEN (arg_min(val, step) - min(val)) / max(wall) END, 9) AS loss_drop_per_sec
FROM ct JOIN ls ON ls.run_id IS NOT DISTINCT FROM ct.run_id GROUP BY ct.run_id""",
    "resumed_throughput": f"""
WITH {RESUMED_CTE},
q AS (SELECT run_id, step, wall, lag(step) OVER w AS ps, lag(wall) OVER w AS pw,
             min(step) OVER (PARTITION BY run_id) AS s0, max(step) OVER (PARTITION BY run_id) AS s1
      FROM ct WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id, step, round(CASE WHEN wall - pw > 0 THEN (step - ps) / (wall - pw) END, 6) AS rate,
       round(CASE WHEN wall > 0 THEN (step - s0) / wall END, 6) AS cum_rate,
       round(CASE WHEN wall > 0 AND step > s0 THEN (s1 - step) / ((step - s0) / wall) END, 3) AS eta_sec FROM q""",
    "run_summary": f"""
WITH {LOG_CTE}
SELECT run_id, count(*) AS n_evals, min(step) AS first_step, max(step) AS last_step,
       (min(struct_pack(v := val, s := step)) FILTER (WHERE val IS NOT NULL)).s AS best_step,
       round(min(val), 6) AS best_val, round(arg_max(val, step), 6) AS final_val,
       round(exp(least(min(val), 20)), 3) AS ppl_best, round(max(elapsed), 3) AS max_elapsed,
       round(CASE WHEN max(elapsed) > 0 THEN (arg_min(val, step) - min(val)) / max(elapsed) END, 9)
         AS loss_drop_per_sec
FROM lg GROUP BY run_id""",

    "loss_ema": f"""
WITH {LOG_CTE},
l AS (SELECT run_id, list(val ORDER BY k) AS vals FROM lg GROUP BY run_id)
SELECT lg.run_id, lg.step,
       CAST(list_reduce(l.vals[1:lg.k], lambda acc, x: 0.9 * acc + 0.1 * x) AS FLOAT) AS ema
FROM lg JOIN l USING (run_id)""",

    "best_so_far": f"""
WITH {LOG_CTE}
SELECT run_id, step, round(min(val) OVER (PARTITION BY run_id ORDER BY k
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS best_so_far
FROM lg""",

    "run_throughput": f"""
WITH {LOG_CTE},
b AS (SELECT run_id, min(step) AS s0, max(step) AS smax FROM lg GROUP BY run_id),
r AS (
  SELECT pv.*, b.s0, b.smax,
         CASE WHEN elapsed - prev_elapsed > 0 THEN (step - prev_step) / (elapsed - prev_elapsed) END AS rate,
         CASE WHEN elapsed > 0 THEN (step - b.s0) / elapsed END AS cum_rate
  FROM pv JOIN b USING (run_id))
SELECT run_id, step, round(rate, 6) AS rate, round(cum_rate, 6) AS cum_rate,
       round(CASE WHEN cum_rate > 0 THEN (smax - step) / cum_rate END, 3) AS eta_sec
FROM r""",

    "overfit_onset": f"""
WITH {LOG_CTE}
SELECT run_id,
       min(CASE WHEN val > prev_val AND train < prev_train THEN step END) AS onset_step,
       CAST(sum(CASE WHEN val > prev_val AND train < prev_train THEN 1 ELSE 0 END) AS BIGINT) AS n_divergent
FROM pv GROUP BY run_id""",

    "run_anomalies": f"""
WITH {LOG_CTE}
SELECT run_id,
       CAST(sum(CASE WHEN isnan(train) OR isinf(train) OR isnan(val) OR isinf(val) THEN 1 ELSE 0 END) AS BIGINT)
         AS n_nonfinite,
       min(CASE WHEN isnan(train) OR isinf(train) OR isnan(val) OR isinf(val) THEN step END) AS first_bad_step
FROM lg GROUP BY run_id""",

    "lr_audit": f"""
WITH {LOG_CTE},
r AS (
  SELECT lg.*, max(CASE WHEN event_type = 'error' THEN step END) OVER (PARTITION BY run_id ORDER BY k
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resume_step,
         max(step) OVER (PARTITION BY run_id) AS mx
  FROM lg),
v AS (
  SELECT run_id, step, resume_step,
         {_lr('step', AUDIT_LR, AUDIT_WARMUP, 'mx')} AS expected,
         {_lr('(step - coalesce(resume_step, 0))', AUDIT_LR, AUDIT_WARMUP, 'mx')} AS logged
  FROM r)
SELECT run_id, step, resume_step, round(expected, 12) AS expected_lr, round(logged, 12) AS logged_lr,
       abs(logged - expected) / expected > 0.01 AS flagged
FROM v""",

    "loss_power_fit": f"""
WITH {LOG_CTE}
SELECT run_id, round(-regr_slope(ln(val), ln(step)), 6) AS exponent,
       round(regr_intercept(ln(val), ln(step)), 6) AS log_c,
       round(regr_r2(ln(val), ln(step)), 6) AS r2,
       count(*) AS n, min(step) AS x_min, max(step) AS x_max,
       any_value((SELECT count(*) FROM lg z WHERE z.run_id = lg.run_id AND NOT (z.step > 0 AND coalesce(z.val, 0) > 0)))
         AS n_dropped
FROM lg WHERE step > 0 AND val > 0 GROUP BY run_id""",

    "loss_fit_curve": f"""
WITH {LOG_CTE},
f AS (
  SELECT run_id, -regr_slope(ln(val), ln(step)) AS a, regr_intercept(ln(val), ln(step)) AS c,
         log10(min(step) * 0.7) AS l0, log10(max(step) * 1.5) AS l1
  FROM lg WHERE step > 0 AND val > 0 GROUP BY run_id),
g AS (SELECT f.*, i FROM f, (SELECT unnest(range(50)) AS i) r)
SELECT run_id, CAST(i AS BIGINT) AS i, round(pow(10.0, l0 + (l1 - l0) * i / 49), 4) AS x,
       round(exp(c) * pow(pow(10.0, l0 + (l1 - l0) * i / 49), -a), 6) AS y
FROM g""",
}
