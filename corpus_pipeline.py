"""The training-data pipeline: stages over ``documents``, each written and read again.

Every stage takes what its predecessor kept, works on all of it, and returns the
columns of ``documents`` (the last: the shards).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokloom.llm import common, decontaminate, jaccard, mixing, quality, sharding

#: Documents whose quality score is lower are rejected.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, fitted on the labels of documents outside fold 0 of 5."""
    model = quality.train(docs, common.read(spark, sf_dir, "labels"))
    return quality.score(docs, model, "_quality").where(f"_quality >= {LEAST_QUALITY}").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; the least id of each group of linked documents stays."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; a document comes as often as the mix takes it."""
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; one row per document of the mix with its shard and slot."""
    return sharding.place(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: SQL cannot express the classifier, the sampled comparison, the hashed order or the curve.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` table."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
