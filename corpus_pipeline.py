"""A corpus pipeline of five stages over `documents`, each an operator of textassay.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textassay.llm.common import documents, is_staged, small_batches, stage
from textassay.llm.exact_dedup import drop_exact_copies
from textassay.llm.mixing import sample_mixture
from textassay.llm.packing import pack_documents
from textassay.llm.quality import keep_good
from textassay.llm.simhash import drop_near_copies

#: Five stages share the same executors and Python workers, which keep what the largest of them once took; so batches and
#: the tokenizer's kept words are smaller here than in the operators by themselves. Rows don't depend on either.
BATCH_BYTES = 1 << 20
MOST_WORDS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-field classifier, fitted on `labels`, calls good; staged, as whole rows pass through Python."""
    with small_batches(spark, BATCH_BYTES):
        return stage(keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "pipeline-quality")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the largest id, of each text."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    with small_batches(spark, BATCH_BYTES):
        return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to tempered source, language and topic margins; staged, as whole rows pass through Python."""
    with small_batches(spark, BATCH_BYTES):
        return stage(sample_mixture(docs), "pipeline-mixing")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces and their places in sequences."""
    with small_batches(spark, BATCH_BYTES):
        return pack_documents(docs, most_words=MOST_WORDS)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        docs = docs if is_staged(docs) else stage(docs, f"pipeline-{name}")
    return docs
