"""Words, pairs and triples of words that are used often, counted by hashes first, so that rare ones never travel as text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hash_counts import bits_for, buckets_for, counted_hashes, marked, marks, packed_numbers, unpacked_numbers
from .lineage import checkpointed
from .memory import frugal
from .shingles import hashed_words, spelled_words

#: Words of a gram, at most.
LONGEST = 3
#: Hashes, and grams, that a task gathers before it passes them on.
GATHERED = 1 << 23
#: Bytes of texts that are worked on at once.
TOGETHER = 2 << 20
#: Places whose grams are told apart at once: three numbers of words below this fit a 64-bit number.
AT_ONCE = 1 << 20
#: The filter of what may be frequent goes to all tasks in parts of two to this power bits, 64 MB; the texts are read once for each.
MOST_BITS = 29

_FOUND = "src string, grams binary, uses binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.LargeBinaryArray, np.ndarray]]:
    """Of batches of (src, text) a source, its words, and for the places where grams begin how many words the text has from there on.

    Words beyond those places are only in the grams that begin before them.
    """
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
        k = 0
        while k < batch.num_rows:
            m = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TOGETHER, "right")))
            of: dict[str | None, list[bytes]] = {}
            for src, text in zip(batch.column(0).slice(k, m - k).to_pylist(), batch.column(1).slice(k, m - k).cast(pa.large_binary()).to_pylist()):
                of.setdefault(src, []).append(text or b"")
            for src, texts in of.items():
                words, per_text = spelled_words(texts)
                left = np.repeat(np.cumsum(per_text), per_text) - np.arange(len(words))
                for at in range(0, len(words), AT_ONCE):
                    yield src, words.slice(at, AT_ONCE + LONGEST - 1), left[at : at + AT_ONCE]
            k = m


def _gram_hashes(src: str | None, hashed: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where grams of ``n`` words begin, and the grams' hashes, whose upper bits are spread evenly."""
    at = np.flatnonzero(left >= n)
    factors = np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    made = np.full(len(at), hashed_words(pa.array([b"\0" if src is None else src.encode()], pa.large_binary()))[0] + np.uint64(n), np.uint64)
    for k, f in enumerate(factors):
        made += hashed[at + k] * f
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        made ^= made >> np.uint64(shift)
        made *= np.uint64(factor)
    return at, made ^ (made >> np.uint64(31))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for src, words, left in _pieces(batches):
        hashed = hashed_words(words)
        for n in range(1, LONGEST + 1):
            yield _gram_hashes(src, hashed, left, n)[1]


def _lines(grams: pa.Array) -> bytes:
    """The grams, each followed by a line break, compressed."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(grams)], pa.int64()), grams), pa.scalar(b"\n", pa.large_binary()))[0].as_py()
    return zstandard.ZstdCompressor(level=9).compress(joined + b"\n")


def _read_lines(packed: bytes) -> pa.LargeBinaryArray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    ends = np.flatnonzero(data == 10)
    offsets = np.append(0, ends - np.arange(len(ends)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def _told_apart(words: pa.LargeBinaryArray, at: np.ndarray, n: int, hashes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different grams of ``n`` words that begin at given places, by their words themselves, with their hashes and uses."""
    coded = words.dictionary_encode()
    codes, of = coded.indices.to_numpy().astype(np.uint64), np.uint64(len(coded.dictionary))
    key = codes[at]
    for k in range(1, n):
        key = key * of + codes[at + k]
    _, first, uses = np.unique(key, return_index=True, return_counts=True)
    parts = [coded.dictionary.take(pa.array(codes[at[first] + k])) for k in range(n)]
    return (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]), hashes[first], uses


def _summed(grams: pa.Array, uses: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each gram once, the sum of its uses, and the number by which each row names it."""
    coded = grams.dictionary_encode()
    codes, total = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
    np.add.at(total, codes, uses)
    return coded.dictionary, total, codes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for src, packed, uses in zip(*[c.to_pylist() for c in batch.columns]):
            grams = _read_lines(packed)
            n = pc.add(pc.count_substring(grams, b" "), 1).cast(pa.int32())
            made = [pa.array([src] * len(grams), pa.string()), n, grams.cast(pa.binary()).cast(pa.string()), pa.array(unpacked_numbers(uses))]
            yield pa.RecordBatch.from_arrays(made, ["src", "n", "gram", "uses"])


def _counted(texts: DataFrame, hashes: DataFrame, least: int, buckets: int, bits: int, part: int, parts: int, gathered: int) -> DataFrame:
    """src, grams, uses of one of the two to the power of ``parts`` parts of all hashes, written out."""
    shared = texts.sparkSession.sparkContext.broadcast(marks(hashes, buckets, bits, range(part << buckets >> parts, (part + 1) << buckets >> parts)))

    of_text = max(0, buckets - 2)  # larger buckets, for sorted neighbours are more alike

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = np.frombuffer(shared.value, np.uint8)
        waiting: dict[str | None, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for src, met in waiting.items():
                grams, uses, codes = _summed(pa.concat_arrays([m[0] for m in met]), np.concatenate([m[2] for m in met]))
                bucket = np.zeros(len(grams), np.int32)
                bucket[codes] = (np.concatenate([m[1] for m in met]) >> np.uint64(63 - of_text) >> np.uint64(1)).astype(np.int32)
                order = pc.sort_indices(pa.table({"bucket": bucket, "gram": grams}), [("bucket", "ascending"), ("gram", "ascending")]).to_numpy()
                edges = np.searchsorted(bucket[order], np.arange((1 << of_text) + 1))
                there = np.flatnonzero(np.diff(edges))
                rows = [order[edges[b] : edges[b + 1]] for b in there]
                packed = [pa.array([_lines(grams.take(pa.array(r))) for r in rows], pa.binary()), pa.array([packed_numbers(uses[r]) for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([src] * len(rows), pa.string()), *packed], ["bucket", "src", "grams", "uses"])
            waiting.clear()

        size = 0
        for src, words, left in _pieces(batches):
            hashed = hashed_words(words)
            for n in range(1, LONGEST + 1):
                at, hashes = _gram_hashes(src, hashed, left, n)
                mine = np.flatnonzero(hashes >> np.uint64(63 - parts) >> np.uint64(1) == part)
                at, hashes = at[mine], hashes[mine]
                may = marked(filtered, hashes, bits, parts)
                if may.any():
                    waiting.setdefault(src, []).append(_told_apart(words, at[may], n, hashes[may]))
                    size += len(waiting[src][-1][1])
            if size >= gathered // 4:
                yield from passed()
                size = 0
        yield from passed()

    def summed(group: pa.Table) -> pa.Table:
        grams, uses, _ = _summed(pa.concat_arrays(map(_read_lines, group.column("grams").to_pylist())), np.concatenate(list(map(unpacked_numbers, group.column("uses").to_pylist()))))
        often = uses >= least
        grams = grams.filter(pa.array(often))
        kept = [group.column("src").slice(0, 1), pa.array([_lines(grams)], pa.binary()), pa.array([packed_numbers(uses[often])], pa.binary())]
        return pa.table(kept, ["src", "grams", "uses"]).slice(0, int(often.any()))

    found = checkpointed(texts.mapInArrow(frugal(counted), f"bucket int, {_FOUND}").groupBy("bucket", "src").applyInArrow(summed, _FOUND))
    shared.destroy()
    return found


def frequent_grams(src: Column, text: Column, docs: DataFrame, least: int, buckets: int | None = None, most_bits: int = MOST_BITS, gathered: int = GATHERED) -> DataFrame:
    """src, n, gram, uses: the words, pairs and triples of lower-case texts that a source uses ``least`` times or more.

    Exact. A first reading of the texts counts hashes; of it comes a filter
    that no frequent gram fails. A second counts the grams themselves that
    pass, by their words; what passed without being frequent is left out. A
    filter too large to go to all tasks goes in parts, with a reading for each.
    ``buckets`` (a power of two), ``most_bits`` and ``gathered`` change the
    work alone. The result is written out, compressed.
    """
    texts = docs.select(src.alias("src"), text.alias("text"))
    buckets = buckets_for(docs) if buckets is None else buckets
    hashes = counted_hashes(texts, _hashes, least, buckets, gathered)
    bits = bits_for(hashes, buckets, 16)
    parts = min(buckets, max(0, bits - most_bits))
    found = [_counted(texts, hashes, least, buckets, bits, part, parts, gathered) for part in range(1 << parts)]
    return reduce(DataFrame.unionByName, found).mapInArrow(frugal(_rows), "src string, n int, gram string, uses long")
