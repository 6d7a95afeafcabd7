"""Queries of the operators, one per operator, and the DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, jaccard, langid, lm, mixing, quality, rules, runs, search, sharding, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_jaccard_join": jaccard.op1_jaccard_join,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_context_mixing": lm.op4_context_mixing,
    "op5_quality": quality.op5_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_language": langid.op7_language,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_hilbert_shards": sharding.op10_hilbert_shards,
    "op11_quality_rules": rules.op11_quality_rules,
    "op12_lexical_search": search.op12_lexical_search,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op8_warc": warc.ORACLE,
    "op12_lexical_search": search.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
