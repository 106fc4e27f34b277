"""SimHash near-dedup by pigeonhole blocks (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix_join import FREQUENT, similar_groups
from ..operators.shingles import word_shingles
from .common import components, frugal, materialize, texts_of, without
from .packing import forget_words

SEED = 42
#: Jaccard similarity of near copies.
SIMILARITY = 0.8
#: Shingles whose bits are counted at once; bounds a task's memory for very long texts.
AT_ONCE = 1 << 15


def fingerprint(text: bytes, width: int) -> bytes:
    """SimHash of a text: big-endian 8 bytes; a bit is 1 if set in over half the shingle hashes."""
    words = text.lower().split()  # of bytes: A-Z only, white space 09-0D and 20 only
    n = max(len(words) - width + 1, min(len(words), 1))
    if not n:
        return bytes(8)
    flat = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    ends = ends[width - 1 :] or ends[-1:]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        pairs = zip(starts[k : min(k + AT_ONCE, n)], ends[k : k + AT_ONCE])
        hashes = b"".join([digest(flat[s : e - 1], SEED) for s, e in pairs])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) and raw (XXH64 of the text as it is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch)
            found = [fingerprint(data[at[i] : at[i + 1]].tobytes(), width) for i in range(len(at) - 1)]
            fp = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fp)], ["doc_id", "raw", "fp"])

    read = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("raw"), "text")
    return read.mapInArrow(frugal(run), "doc_id long, raw long, fp long")


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, join_up_to: int = 64) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` that connect all pairs at up to ``distance`` 2.

    Fingerprints are split into ``blocks`` parts. Two that differ in two bits
    agree in all but two parts, so every choice of blocks - 2 parts is a key on
    which they may meet. Up to ``join_up_to`` fingerprints of one key are joined and their
    distance verified. For more, each goes to itself and to the values one bit
    off outside the key: two fingerprints are within two bits exactly if they
    share such a value, at most 65 share one, and the least of them stands for
    all. So no group makes all its pairs, and no link between components is lost.
    """
    if distance != 2:
        raise ValueError("links are made for a distance of 2")
    width = 64 // blocks
    masks = []
    for parts in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << width) - 1) << (p * width) for p in parts)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(masks)])).alias("e")
    ).select("fp", "e.k", "e.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(sizes, ["k", "key"]))
    few, many = met.where(F.col("n") <= join_up_to), met.where(F.col("n") > join_up_to)
    pairs = (
        few.select("k", "key", F.col("fp").alias("a"))
        .join(few.select("k", "key", F.col("fp").alias("b")), ["k", "key"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    one_off = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    between = (
        many.select("fp").distinct()
        .select("fp", F.explode(one_off).alias("bit"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
        .groupBy("z")
        .agg(F.collect_set("fp").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(between).distinct()


def _decisions(docs: DataFrame, width: int) -> DataFrame:
    made = materialize(fingerprints(docs, width))
    fps = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    fps = materialize(fps)
    linked = components(links(fps.select("fp")))
    rooted = fps.join(linked, fps["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return made.join(rooted.join(classes, "root").select("fp", "root", "component_id"), "fp")


def near_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without ASCII white space after lower-casing A-Z; shingles
    of ``width`` words count as often as they occur; a text of fewer words is
    one shingle, and one of none has fingerprint zero and is linked like any
    other. Documents whose fingerprints differ in at most two bits are linked;
    component_id is the smallest doc_id reachable.

    Null text counts as empty. A null doc_id names a component only if it has
    no other. Repeated rows come back as often as they come. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    return _decisions(docs, width).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    forget_words()
    return word_shingles(texts, width)


def proposals(docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of ``raw``, XXH64 of a text: texts whose fingerprints of ``width``-word shingles differ in at most two bits.

    Texts of one fingerprint meet the least of them, and of two linked
    fingerprints the least texts meet, so a crowd makes a pair a text.
    """
    made = materialize(fingerprints(docs, width).select("raw", "fp").distinct())
    least = materialize(made.groupBy("fp").agg(F.min("raw").alias("least")))
    alike = made.join(least, "fp").where("raw <> least").select(F.col("raw").alias("a"), F.col("least").alias("b"))
    of = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}"))
    met = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b")
    return alike.unionByName(met.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY, frequent: int = FREQUENT) -> DataFrame:
    """One document of each group of near copies, that with its smallest doc_id, with all columns of ``docs``.

    Documents are linked if their sets of ``width``-word shingles (of words as
    in ``near_dedup``) reach a Jaccard similarity of ``similarity``. SimHash by
    pigeonhole blocks proposes pairs (see ``proposals``), which are verified and
    connected first. At 0.8 fingerprints differ in 4 to 14 bits, and no link may
    be lost, so an exact prefix-filter join then finds what is similar and not
    connected yet. See ``similar_groups``, also for ``frequent``.

    Groups are told apart by their roots: texts that only share a doc_id, or
    have none, all stay. A document without a doc_id is kept if its group has
    no other; of equal rows one stays. Null text counts as empty, texts of
    fewer than ``width`` words are one shingle, so equal ones are copies; very
    long texts are compared whole. An empty table gives no rows. Columns beside
    doc_id and text pass through whatever their names.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    linked = similar_groups(keyed.select(F.col("raw").alias("key"), "text"), partial(_shingles, width=width), similarity, frequent=frequent, proposed=proposals(docs, width))
    counted = materialize(keyed.groupBy("doc_id", "raw").agg(F.count("*").alias("n")))
    rooted = counted.join(linked.withColumnRenamed("node", "raw"), "raw", "left").withColumn("root", F.coalesce("root", "raw"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"))
    return without(docs, rooted.join(first, "root").select("doc_id", "raw", "n", order.eqNullSafe(F.col("first")).alias("kept")))
