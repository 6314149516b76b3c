"""From raw documents to token ids: the text operators one after another.

Every stage takes the documents that the stage before it kept and returns those that it
keeps, with the columns of ``documents``; the last one returns what it makes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import exact_dedup, jaccard_join, mixing, quality, sentencepiece
from sitewatch.llm.queries import TOKENIZER
from sitewatch.operators.checkpoints import cut


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio."""
    return quality.keep_quality(docs, _labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id."""
    return jaccard_join.drop_near_copies(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says."""
    return mixing.mixed_documents(docs, mixing.label_domains(_labels(spark, sf_dir)))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return sentencepiece.round_trip(docs, TOKENIZER).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("mixing", mix_domains),
    ("sentencepiece", token_ids),
]

#: No SQL can express the hashed likelihood ratio; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result but the last is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
