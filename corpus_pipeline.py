"""The corpus pipeline: quality, exact and near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. The last returns the pieces of the packed
sequences, the others the documents that stay, with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import chunk_dedup, decontaminate, packing, quality, simhash
from sparkloom.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold.

    Null and empty texts are scored like any, very long ones as a whole; equal
    texts are kept or dropped alike; an empty table stays empty; clashing
    columns pass through. See ``quality.keep_good``.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id.

    Null texts are empty ones; of rows equal in doc_id and text one stays; an
    empty table stays empty; clashing columns pass through. See
    ``chunk_dedup.drop_duplicates``.
    """
    return chunk_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a Jaccard similarity of 5-word shingles of 0.8 the one with the smallest doc_id.

    Null and empty texts are one group, texts of under five words are compared
    whole, very long ones too; documents without a doc_id stay if their group
    has no other; an empty table stays empty; clashing columns pass through.
    See ``simhash.drop_near_duplicates``.
    """
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Null and empty texts hold none, very long ones are searched whole; equal
    texts go or stay alike; an empty table stays empty; clashing columns pass
    through. See ``decontaminate.keep_clean``.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 4096 tokens.

    Null and empty texts are one end token, longer texts than a sequence are
    cut; repeated rows are packed each time; an empty table gives no pieces;
    other columns aren't read. See ``packing.pack``.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL can't express the trained ranking, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder, read again, and deleted when the next one is written."""
    docs, drop = table(spark, sf_dir, "documents"), lambda: None
    try:
        for _, stage in STAGES[:-1]:
            docs, drop_new = written(stage(spark, docs, sf_dir))
            drop()
            drop = drop_new
        # The pieces are written out before they are packed, so the documents aren't read again.
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        drop()
