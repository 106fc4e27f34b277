"""How often 64-bit hashes are met, counted by their upper bits in compressed lists, and bounded filters made of that."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed
from .memory import frugal

#: Bytes of input for which there is a bucket of hashes.
PER_BUCKET = 4 << 20
#: Bits of a hash that are passed on beside its bucket: about one value in four is met, so few hashes share one.
REST = 23

_LISTS = "bucket int, hashes binary, uses binary"


def _planes(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers' lowest bytes, then all second ones and so on, compressed."""
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def _from_planes(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_numbers(values: np.ndarray) -> bytes:
    return _planes(values.astype("<i8"))


def unpacked_numbers(packed: bytes) -> np.ndarray:
    return _from_planes(packed, "<i8")


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers by their differences."""
    return _planes(np.diff(values, prepend=np.uint32(0)).astype("<u4"))


def unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(packed, "<u4"), dtype=np.uint32)


def buckets_for(rows: DataFrame) -> int:
    """To what power of two there are buckets of hashes for a table: by its size, and one a core at least."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 1 << 30 if size >> 50 else size  # not known
    return min(14, (max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // PER_BUCKET)) - 1).bit_length())


def counted_hashes(texts: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, buckets: int, gathered: int) -> DataFrame:
    """bucket, n, hashes, uses: the ``REST`` bits after a bucket's of all hashes that are met ``least`` times or more, sorted, and how often each; n of them. Written out.

    ``made`` makes hashes of the rows. A task counts ``gathered`` of them
    together. Hashes that agree in these bits count together, so none is missed.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def passed() -> pa.RecordBatch:
            met = np.concatenate([*waiting, np.zeros(0, np.uint64)])
            waiting.clear()
            met.sort()
            at = np.flatnonzero(np.append(np.ones(min(1, len(met)), bool), met[1:] != met[:-1]))
            met, uses = met[at], np.diff(np.append(at, len(met)))
            edges = np.searchsorted(met, np.arange((1 << buckets) + 1, dtype=np.uint64) << np.uint64(REST))
            there = np.flatnonzero(np.diff(edges))
            rest = (met & np.uint64((1 << REST) - 1)).astype(np.uint32)
            parts = [slice(edges[b], edges[b + 1]) for b in there]
            columns = [pa.array(there.astype(np.int32)), pa.array([_packed(rest[x]) for x in parts], pa.binary()), pa.array([packed_numbers(uses[x]) for x in parts], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "hashes", "uses"])

        size = 0
        for hashes in made(batches):
            waiting.append(hashes >> np.uint64(64 - buckets - REST))
            size += len(hashes)
            if size >= gathered:
                yield passed()
                size = 0
        yield passed()

    def often(group: pa.Table) -> pa.Table:
        met = np.concatenate([unpacked(x) for x in group.column("hashes").to_pylist()])
        uses = np.concatenate([unpacked_numbers(x) for x in group.column("uses").to_pylist()])
        order = np.argsort(met, kind="stable")
        met, uses = met[order], np.cumsum(uses[order])
        last = np.flatnonzero(np.append(met[1:] != met[:-1], True))
        met, uses = met[last], np.diff(uses[last], prepend=0)
        met, uses = met[uses >= least], uses[uses >= least]
        return pa.table([group.column("bucket").slice(0, 1), pa.array([len(met)], pa.int64()), pa.array([_packed(met)], pa.binary()), pa.array([packed_numbers(uses)], pa.binary())], ["bucket", "n", "hashes", "uses"])

    return checkpointed(texts.mapInArrow(frugal(lists), _LISTS).groupBy("bucket").applyInArrow(often, "bucket int, n long, hashes binary, uses binary"))


def bits_for(found: DataFrame, buckets: int, values: int) -> int:
    """The upper bits of hashes that a filter goes by: so many values for each that was found, so about one in as many others passes."""
    return min(buckets + REST, max(buckets + 3, (values * (found.agg(F.sum("n")).first()[0] or 0)).bit_length()))


def marks(found: DataFrame, buckets: int, bits: int, within: range) -> bytes:
    """A bit for each value that the upper ``bits`` bits of hashes of some buckets have, set for those that were found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked = np.zeros(1 << (bits - buckets), bool)
                marked[unpacked(packed) >> np.uint32(REST - bits + buckets)] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(marked, bitorder="little").tobytes()], pa.binary())], ["bucket", "marks"])

    made = found.where(F.col("bucket").between(within.start, within.stop - 1)).select("bucket", "hashes").mapInArrow(frugal(run), "bucket int, marks binary").toArrow()
    there = dict(zip(made["bucket"].to_pylist(), made["marks"].to_pylist()))
    return b"".join(there.get(b, bytes(1 << (bits - buckets - 3))) for b in within)


def marked(filtered: np.ndarray, hashes: np.ndarray, bits: int, parts: int = 0) -> np.ndarray:
    """Which hashes a filter lets through; it is one of two to the power of ``parts`` parts of all."""
    bit = hashes << np.uint64(parts) >> np.uint64(64 - bits + parts)
    return (filtered[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
