"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark passages, tokens."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, linededup, neardup, quality
from millrace.llm.store import give_back, keep_batches_small, stored

#: Rows of an Arrow batch. An executor holds a batch of whole texts several times over, in the JVM and in Python, for each core.
BATCH_ROWS = 500


def _beside(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lean(stage):
    """The stage, begun with what earlier ones left in the driver's allocators given back."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_lean
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    keep_batches_small(spark, BATCH_ROWS)
    return quality.keep_good(docs, _beside(spark, sf_dir, "labels"), threshold=0.7)


@_lean
def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go; n_chars follows the text."""
    return linededup.without_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_lean
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with near-equal sets of five-word shingles, the one with the least id stays."""
    return neardup.deduplicated(docs, k=5, percent=80)


@_lean
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    keep_batches_small(spark, BATCH_ROWS)
    return decontam.clean(docs, _beside(spark, sf_dir, "benchmark"))


@_lean
def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with the digests of its ids and of the decoded text."""
    keep_batches_small(spark, BATCH_ROWS)
    return bpe.encode_column(docs, bpe.load_tables(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", no_repeated_lines),
    ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("bpe encoding and decoding", as_tokens),
]

#: Learned scores and hashed signatures are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again."""
    docs = _beside(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
