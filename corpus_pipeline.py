"""From raw documents to packed training batches: five stages over the whole corpus.

Each stage reads what its predecessor kept, as Parquet, and its decisions take effect: the first
three drop documents that they reject or that repeat others, the fourth takes documents by their
sampling rates, the last deals what is left into batches. All but the last return the columns of
their input. Stages are written to the shared folder, so each survives lost executors on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import minhash, mixing, packing, pu_quality, quality_rules
from panelspark.session import shared_dir


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier takes for good."""
    return pu_quality.score(docs, _labels(spark, sf_dir), docs.columns).where("predicted = 1").select("_row.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the trees over their statistics.

    The trees learn from all labelled documents, as the stage before leaves hardly any bad ones.
    """
    learn = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules.judge(docs, _labels(spark, sf_dir), docs.columns, learn=learn).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return minhash.distinct_rows(docs).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken so that sources, languages and topics meet their target shares of tokens."""
    return mixing.mix(docs).where("_mix.taken").select(docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_to, batch, place) of every document."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", batches),
]
#: Learned models and near copies cannot be said in SQL. Tests compare near copies with all pairs, the other stages with their
#: operators, which have plain versions in tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
