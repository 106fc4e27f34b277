"""Queries over the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .alignment import align
from .chunk_dedup import exact_dedup
from .common import table
from .decontaminate import contaminated
from .infilling import digest as digest_infilling
from .infilling import fill_in_middle
from .language import identify
from .packing import pack
from .perspectives import rotate
from .pii import digest, find_personal_data
from .repeats import remove_repeats
from .quality import score as score_quality
from .sharding import shard
from .simhash import near_dedup
from .toxicity import score as score_toxicity


def op1_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays; null texts are empty ones."""
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dedup(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and list of the personal data in every document."""
    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("raw")


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side."""
    return rotate(table(spark, sf_dir, "conversations"))


def op6_run_index_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeats of 400 bytes take from every document."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, sizes near equal."""
    return shard(table(spark, sf_dir, "documents"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(table(spark, sf_dir, "documents"))


def op11_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by character models of all others' languages outside the held-out fold."""
    return identify(table(spark, sf_dir, "documents"))


def op12_event_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, with hashes of its output and of what is restored from it."""
    return digest_infilling(fill_in_middle(table(spark, sf_dir, "documents")))


def op13_event_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the links' counts in the whole corpus."""
    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_chunk_recipe_dedup,
        op2_simhash_pigeonhole,
        op3_personal_data,
        op4_pairwise_quality,
        op5_perspective_rotation,
        op6_run_index_repeats,
        op7_bm25_decontamination,
        op8_differencing_shards,
        op9_counterfactual_toxicity,
        op10_large_item_packing,
        op11_kneser_ney_language,
        op12_event_infilling,
        op13_event_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chunk_recipe_dedup": oracles.OP1, "op3_personal_data": oracles.op3(), "op5_perspective_rotation": oracles.OP5, "op12_event_infilling": oracles.OP12}
