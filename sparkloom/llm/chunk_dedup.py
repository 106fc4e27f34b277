"""Exact dedup by content-defined chunk recipes (operator 1)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, frugal, materialize, texts_of, without

#: A boundary falls where the top bits of a 32-byte rolling hash are zero: about every 2 KiB.
BOUNDARY_BITS = 11
#: No chunk is longer; a run without boundaries is cut at multiples of this.
MAX_CHUNK = 1 << 16

_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place (fewer at the start)."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    return h


def chunk_ends(data: np.ndarray, bits: int = BOUNDARY_BITS, longest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of one text; they depend on its bytes alone."""
    n = len(data)
    cuts = np.flatnonzero(rolling(data)[31:] >> np.uint32(32 - bits) == 0) + 32 if n > 32 else np.zeros(0, np.int64)
    ends, at = [], 0
    for end in [*cuts[cuts < n].tolist(), n]:
        while end - at > longest:
            at += longest
            ends.append(at)
        if end > at or n == 0:
            ends.append(end)
            at = end
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, at = texts_of(batch)
        data = LOWER[raw]
        shas, sizes, digests, checks, lengths = [], [], [], [], []
        for i in range(len(at) - 1):
            text = data[at[i] : at[i + 1]]
            view = memoryview(text)
            shas.append(hashlib.sha256(view).hexdigest())
            ends = chunk_ends(text)
            begin = 0
            for end in ends:
                part = view[begin:end]
                digests.append(xxhash.xxh3_64_intdigest(part) - (1 << 63))
                checks.append(hashlib.sha256(part).digest()[:16])
                lengths.append(end - begin)
                begin = end
            sizes.append(len(ends))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        chunks = pa.StructArray.from_arrays(
            [pa.array(digests, pa.int64()), pa.array(checks, pa.binary()), pa.array(lengths, pa.int64())],
            ["h", "check", "size"],
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, chunks)],
            ["uid", "doc_id", "raw", "text_sha256", "chunks"],
        )


def _decisions(docs: DataFrame) -> DataFrame:
    read = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("raw"), "text"
    )
    recipes = materialize(
        read.mapInArrow(
            frugal(_recipes),
            "uid long, doc_id long, raw long, text_sha256 string, chunks array<struct<h long, check binary, size long>>",
        )
    )
    # The chunk table has one row per distinct chunk. Its identifier is the hash, verified by
    # length and digest; where chunks share a hash, a rank among them is part of it.
    rows = recipes.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", "c.*")
    clash = (
        rows.groupBy("h", "size", "check")
        .agg(F.lit(1).alias("one"))
        .groupBy("h")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("size", "check"))).alias("same"))
        .where("n > 1")
        .select("h", F.posexplode("same").alias("rank", "c"))
        .select("h", "rank", "c.*")
    )
    ranks = (
        rows.join(clash, ["h", "size", "check"])
        .groupBy("uid")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    )
    lists = (
        recipes.withColumn("ids", F.transform("chunks", lambda c: c["h"]))
        .drop("chunks")
        .join(ranks, "uid", "left")
        .withColumn("recipe", F.struct("ids", F.coalesce("ranks", F.array().cast("array<struct<pos int, rank int>>")).alias("ranks")))
        .drop("ids", "ranks")
    )
    groups = lists.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("keep")
    )
    # Written out, so that both sides of the join are dealt anew and a hot recipe's rows can be split.
    return lists.join(materialize(groups), "recipe").withColumn("kept", F.col("uid") == F.col("keep.uid"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are identical after lower-casing A-Z. Each text
    is cut by content into chunks where it lies; only chunk hashes travel. A
    chunk table turns (hash, length, digest) into one verified identifier, so
    that a clash of 64-bit hashes can't make different chunks one; documents
    are equal when their ordered identifier lists are. Of a group, the row
    with the largest doc_id stays.

    Null text counts as empty; empty texts are one group. A null doc_id is
    smaller than any other; of several rows with the largest doc_id exactly
    one stays. An empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    return _decisions(docs).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        "kept",
        "text_sha256",
        F.size("recipe.ids").cast("long").alias("n_chunks"),
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns: of equal texts the one with the largest doc_id.

    Rows alike in doc_id and text are one: of them one stays. Decisions are
    made on hashes; texts move once at most, to meet them by doc_id. Null text
    counts as empty, and all empty texts are one group; a null doc_id is
    smaller than any other. Very long texts are chunked where they lie. An
    empty table gives no rows. Columns beside doc_id and text pass through
    whatever their names.
    """
    counted = _decisions(docs).groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    return without(docs, counted)
