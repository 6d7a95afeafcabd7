"""Registry of named queries: Spark builders and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus_oracle, corpus_plans, runs_plans, scoring_plans, streaming_plans, tokenizer_plans

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(corpus_plans.QUERIES)
    out.update(runs_plans.QUERIES)
    out.update(scoring_plans.QUERIES)
    out.update(tokenizer_plans.QUERIES)
    out.update(streaming_plans.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(corpus_oracle.ORACLE)
    out.update(runs_plans.ORACLE)
    out.update(scoring_plans.ORACLE)
    out.update(tokenizer_plans.ORACLE)
    out.update(streaming_plans.ORACLE)
    return out
