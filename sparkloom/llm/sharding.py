"""Byte-balanced shards by Karmarkar-Karp differencing (operator 8)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 24
#: Partial partitions that one task combines: the width of the tree, part of the method.
WIDTH = 16_384
#: Rows that one task numbers.
PER_SLOT_BUCKET = 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions: ``sums`` has a row for each, of its k part sums.

    The two with the largest spread are combined again and again, the largest
    part of one with the smallest of the other. Returns the final k sums,
    largest first, and for each row and part the place where it went.
    """
    n, k = sums.shape
    orders = [np.argsort(-row, kind="stable") for row in sums]
    parts = [row[o] for row, o in zip(sums, orders)]
    heap = [(-(int(p[0]) - int(p[-1])), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = parts[a] + parts[b][::-1]
        order = np.argsort(-both, kind="stable")
        parts[a] = parts[b] = None  # no longer needed
        parts.append(both[order])
        made.append((a, b, order))
        heapq.heappush(heap, (-(int(both[order[0]]) - int(both[order[-1]])), len(parts) - 1))
    place: list[np.ndarray | None] = [None] * len(parts)
    place[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        a, b, order = made[at]
        here = np.empty(k, np.int64)
        here[order] = place[n + at]
        place[a], place[b] = here, here[::-1]
        place[n + at] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, orders[i]] = place[i]
    return parts[-1], out


def _units_to_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Single groups: each is a partition with one filled part."""
    pdf = pdf.sort_values(["bytes", "key", "cut"], ascending=[False, True, True], ignore_index=True)
    sums = np.zeros((len(pdf), SHARDS), np.int64)
    sums[:, 0] = pdf["bytes"]
    _, place = difference(sums)
    return pdf.assign(part=place[:, 0])[["tuple", "key", "cut", "bytes", "part"]]


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial partitions, a row for each and part."""
    ids = np.sort(pdf["tuple"].unique())
    sums = np.zeros((len(ids), SHARDS), np.int64)
    row = np.searchsorted(ids, pdf["tuple"])
    sums[row, pdf["part"]] = pdf["bytes"]
    _, place = difference(sums)
    return pdf.assign(next_part=place[row, pdf["part"]])[["tuple", "part", "upper", "next_part", "bytes"]]


def assign_groups(spark: SparkSession, units: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, cut, shard) of indivisible ``units`` (key, cut, bytes).

    Differencing is a tree of combinations, so it is done level by level: each
    task combines up to about ``width`` units into one partial partition, the next
    level combines those, until one is left. No task or driver sees more.
    """
    tuples = max(1, -(-units.count() // width))
    placed = materialize(
        units.withColumn("tuple", F.pmod(F.xxhash64("key", "cut"), F.lit(tuples)))
        .groupBy("tuple")
        .applyInPandas(_units_to_parts, "tuple long, key binary, cut long, bytes long, part int")
    )
    now = placed
    while tuples > 1:
        tuples = -(-tuples // width)
        sums = now.groupBy("tuple", "part").agg(F.sum("bytes").alias("bytes"))
        moved = materialize(
            sums.withColumn("upper", F.pmod("tuple", F.lit(tuples)))
            .groupBy("upper")
            .applyInPandas(_combine, "tuple long, part int, upper long, next_part int, bytes long")
        )
        now = now.join(moved.drop("bytes"), ["tuple", "part"]).select(
            "key", "cut", "bytes", F.col("upper").alias("tuple"), F.col("next_part").alias("part")
        )
    return now.select("key", "cut", F.col("part").alias("shard"))


def shard(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards get nearly equal bytes, a document counting its UTF-8
    bytes plus 8. Documents of equal text are one group and go to one shard. A
    group of more bytes than a shard's fair share can't be balanced so: its
    documents count as groups of their own (fewer than ``SHARDS`` such groups
    can exist). Slots run from 0 in each shard without gaps.

    Null text has no bytes and CRC 0 and is a group apart from empty text.
    Repeated rows, ties and null doc_ids are documents like any other. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"null")).alias("key"),
        )
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    total = groups.agg(F.sum("bytes"), F.count("*")).first()
    fair = (total[0] or 0) / SHARDS
    # At most SHARDS - 1 groups exceed a fair share: the list has a proven bound.
    large = [r for r in groups.where(F.col("bytes") > fair).collect()] if total[1] else []
    cuts = spark.createDataFrame([(bytes(r["key"]), True) for r in large], "key binary, parted boolean")
    keyed = rows.join(F.broadcast(cuts), "key", "left").select(
        "uid", "doc_id", "size", "text_crc32", "key", F.when(F.col("parted"), F.col("uid")).otherwise(-1).alias("cut"),
    )
    units = keyed.groupBy("key", "cut").agg(F.sum("size").alias("bytes"))
    placed = materialize(assign_groups(spark, units))
    dealt = materialize(keyed.join(placed, ["key", "cut"]).drop("key", "cut"))
    # Slots: numbered within (shard, bucket), then moved on by what earlier buckets of the shard hold.
    buckets = max(1, rows.count() // (SHARDS * PER_SLOT_BUCKET) + 1)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    before = (
        dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    numbered = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "uid")))
    return numbered.join(before, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
