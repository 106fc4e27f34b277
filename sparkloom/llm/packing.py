"""Best-fit packing with large-item matching (operator 10)."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, frugal, give_back, materialize, release_memory, texts_of

CAPACITY = 4096
#: The id that ends every document.
END_ID = 1
#: Words whose ids a Python worker remembers; when there are more it starts anew.
REMEMBERED = 500_000
#: Bytes of texts whose words are looked up at once.
TOGETHER = 2 << 20
#: Words that go to the tokenizer at once: it keeps an offset and a string for each token.
ENCODED = 1 << 12
#: Pieces that are packed together in one task.
PER_BUCKET = 20_000

_memory: dict[str, WordIds] = {}
# Byte tables: line ends to spaces, with and without lower case; ASCII letters.
_ONLY_SPACES = np.arange(256, dtype=np.uint8)
_ONLY_SPACES[10] = 32
_PLAIN = LOWER.copy()
_PLAIN[10] = 32
_LETTER = np.isin(LOWER, np.arange(97, 123))


class WordIds:
    """Token ids of texts, through a memory of the ids of their words.

    The vocabulary's own pre-tokeniser drops white space and never joins what
    it parts, so the ids of a text are those of its words in turn. It ignores
    case; words are remembered in lower case where a letter A-Z isn't followed
    by a combining mark (those texts are taken as they are).
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        # Spark's tasks are the parallelism; threads of the tokenizer's own would take cores from other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words of letters alone are one pre-token each, so they are
        encoded as one text and parted after the ids that end a word."""
        texts = [w.decode() for w in words]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        others = set(range(len(texts)))
        out = [b""] * len(words)
        for k in range(0, len(letters), ENCODED):
            part = letters[k : k + ENCODED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and at[-1] == len(ids):
                flat, begin = ids.tobytes(), 0
                for i, end in zip(part, (at * 4).tolist()):
                    out[i] = flat[begin:end]
                    begin = end
                others.difference_update(part)
        rest = sorted(others)
        for k in range(0, len(rest), ENCODED):
            part = rest[k : k + ENCODED]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Words with a comma or full stop after an ASCII letter are parted there, as the pre-tokeniser does."""
        stems = [w[:-1] if w[-1:] in (b",", b".") and w[-2:-1].isalpha() else w for w in words]
        need = [w for w in dict.fromkeys([*stems, b",", b"."]) if w not in self.known]
        self.known.update(zip(need, self._encode(need)))
        for w, s in zip(words, stems):
            if w is not s:
                self.known[w] = self.known[s] + self.known[w[-1:]]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, learnt where they aren't remembered."""
        known = self.known
        ids = list(map(known.get, words))
        fresh = [w for w, x in zip(words, ids) if x is None]
        if not fresh:
            return ids
        if len(known) + 2 * len(fresh) > self.remembered:
            known.clear()
            fresh = words
        self._learn(fresh)
        return list(map(known.get, words))

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id.

        Words are parted and made distinct by Arrow; Python sees each distinct
        word once, and Arrow puts the ids in their places.
        """
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        marked = np.flatnonzero(_LETTER[data[:-1]] & (data[1:] >= 0xCC))
        plain = _PLAIN[data]
        for i in np.unique(np.searchsorted(at, marked, "right") - 1).tolist():
            plain[at[i] : at[i + 1]] = _ONLY_SPACES[data[at[i] : at[i + 1]]]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain)])
        lists = pc.split_pattern(whole, b" ")
        words = lists.flatten().dictionary_encode()
        ids = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, placed = pa.array(ids, pa.large_binary()).take(words.indices).buffers()
        edges = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()].tolist()
        flat = memoryview(placed or b"")
        return [bytes(flat[a:b]) for a, b in zip(edges, edges[1:])]


def _tokenizer(path: str) -> WordIds:
    if path not in _memory:
        _memory[path] = WordIds(path)
    return _memory[path]


def forget_words() -> None:
    """For a worker that goes on to other work: what it remembers of words is let go."""
    if _memory:
        _memory.clear()
        release_memory()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: every text's ids and its end id, cut after ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _tokenizer(path or vocabulary())
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            data, at = texts_of(whole)
            k = 0
            while k < whole.num_rows:
                m = max(k + 1, int(np.searchsorted(at, at[k] + TOGETHER, "right")) - 1)
                batch, begin = whole.slice(k, m - k), k
                k = m
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of.of([data[at[r] : at[r + 1]].tobytes() for r in range(begin, m)])):
                    view = memoryview(ids + end)
                    for p, s in enumerate(range(0, len(view), 4 * capacity)):
                        part = view[s : s + 4 * capacity]
                        rows.append(i)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )
                give_back()

    read = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    return read.mapInArrow(frugal(run), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin number for each length (at most ``capacity``).

    Items above a third of the capacity come first, longest first, each with
    the longest other that fits beside it: no bin holds three. The rest, longest
    first, go where the least room remains. Sets of lengths and of rooms are
    kept as bits of one integer, so each step finds its place at once.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    third = capacity // 3
    large = [i for i in order.tolist() if lengths[i] > third]
    by_length: dict[int, list[int]] = {}
    for i in reversed(large):
        by_length.setdefault(int(lengths[i]), []).append(i)
    there = sum(1 << n for n in by_length)
    rooms: dict[int, list[int]] = {}
    room_bits = 0
    made = 0

    def take(n: int) -> int:
        nonlocal there
        i = by_length[n].pop()
        if not by_length[n]:
            there ^= 1 << n
        return i

    while there:
        first = take(there.bit_length() - 1)
        room = capacity - int(lengths[first])
        bins[first] = made
        if fits := there & ((1 << (room + 1)) - 1):
            second = take(fits.bit_length() - 1)
            bins[second] = made
            room -= int(lengths[second])
        rooms.setdefault(room, []).append(made)
        room_bits |= 1 << room
        made += 1
    for i in order[len(large) :].tolist():
        n = int(lengths[i])
        if fits := room_bits >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                room_bits ^= 1 << room
        else:
            b, room, made = made, capacity, made + 1
        bins[i] = b
        rooms.setdefault(room - n, []).append(b)
        room_bits |= 1 << (room - n)
    return bins


_PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Places for pieces: their columns, sequence_id and offset.

    A piece that fills a sequence has one for itself and isn't moved. The rest
    are dealt at random into buckets of about ``per_bucket`` pieces, each
    packed in one task; a bucket wastes at most what its last few sequences
    hold, under a thousandth of it. Equal lengths or copies never share a key.
    """
    partial = cut.where(F.col("length") < capacity)
    count = partial.count()
    buckets = max(1, -(-count // per_bucket))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "piece"], ignore_index=True)
        bins = best_fit(pdf["length"].to_numpy(), capacity)
        order = np.lexsort((-pdf["length"].to_numpy(), bins))
        ran = np.cumsum(pdf["length"].to_numpy()[order])
        first = np.flatnonzero(np.diff(bins[order], prepend=-1))
        before = ran - pdf["length"].to_numpy()[order]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(pdf))))
        pdf["sequence_id"] = pdf["bucket"] * (1 << 32) + bins
        pdf["offset"] = offset
        return pdf[_PACKED.names]

    packed = (
        partial.withColumn("bucket", F.pmod(F.xxhash64("uid", "piece"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(run, _PACKED)
    )
    full = cut.where(F.col("length") >= capacity).select(
        *_PACKED.names[:6],
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document becomes its token ids and ``end_id``; longer ones are cut
    into pieces of ``capacity`` ids, the last may be shorter. Pieces are packed
    into sequences of at most ``capacity`` ids, see pack_pieces.

    Null and empty texts are one end id. Repeated rows and repeated or null
    doc_ids are documents of their own. Very long texts give as many pieces as
    they need. An empty table gives no rows. Other columns are not read,
    whatever their names.
    """
    cut = materialize(pieces(docs, path, capacity, end_id))
    return pack_pieces(cut, capacity, per_bucket).drop("uid")
