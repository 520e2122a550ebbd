"""A training corpus from raw documents: quality rules, toxicity, near-duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's rows as a
table in the shared folder and reads them again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import bpe, mixing, quality, similar_texts, toxicity
from loomframe.llm.common import drop, durable, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    return quality.filter_quality(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.filter_toxic(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id."""
    return similar_texts.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard by shard."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    return bpe.digests(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL has no learned rules, kernels or fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)  # its rows are in the next table
        before = docs
    return docs
