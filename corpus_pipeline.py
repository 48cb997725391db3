"""A corpus pipeline of five operators, each stage working on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs; all but the last return the
columns of documents.

Edge cases: documents without words (null, empty) fail the base test of the first
stage; null ids and sources stay what they are and go through every stage; repeated rows
are one near-duplicate group, of which one stays; ties there go to the
smallest id; very long texts are processed whole; an empty table stays empty
through all stages; further columns, whatever their names, are carried along to the last stage but one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm import decontam, jaccard, mixing, quality, wavelet
from chronoloom.llm.common import written
from chronoloom.llm.queries import _vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or are probably bad go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by 80 % of their five-word shingles, directly or in turn, one stays."""
    return jaccard.representatives(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, and each document's place in them."""
    return wavelet.round_trip(docs, _vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing sources", mixing_sources),
    ("token output", token_output),
]
#: The vote model of the first stage is fitted by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
