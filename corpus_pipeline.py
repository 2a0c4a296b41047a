"""Curation of a training corpus in five stages.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of docs; the last adds `copy`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.attention_mil import accepted
from lodestone.llm.boosted_pii import redacted_docs
from lodestone.llm.cluster import stored
from lodestone.llm.decontaminate import without_benchmark
from lodestone.llm.jaccard_join import one_of_each_group
from lodestone.llm.pivotal_mix import mixed


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as low in quality or toxic, go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the lowest doc_id."""
    return one_of_each_group(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced in the texts; n_chars follows."""
    return redacted_docs(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as its source's target weight asks; `copy` counts from 1."""
    return mixed(docs)


STAGES = [
    ("quality_classifier", _quality),
    ("ngram_jaccard_join", _near_duplicates),
    ("benchmark_decontamination", _benchmark),
    ("pii", _pii),
    ("mixing", _mix),
]

#: SQL can't express the trained classifier, the trained PII judge and the random rounding; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
