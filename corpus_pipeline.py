"""documents to token shards: five stages, each written as a table and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from partloom.llm.decontam import drop_contaminated
from partloom.llm.mixing import mix_documents
from partloom.llm.quality import keep_good
from partloom.llm.shared import file_row, stored, table
from partloom.llm.simhash import drop_near_copies
from partloom.llm.sstable import read_tokens, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are more likely than not toxic or of low quality."""
    return keep_good(docs, table(spark, sf_dir, "labels"), row=file_row())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, that with the smallest id."""
    return drop_near_copies(docs, row=file_row())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten words of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), row=file_row())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mix_documents(docs, row=file_row())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the shards hold of each document of the mix."""
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), digest=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", tokens),
]

#: No SQL: a fitted model, fingerprints and a tokenizer. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
