"""Benchmark decontamination with a BM25 index and block-max WAND (operator 7)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, frugal, materialize, texts_of

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
ITEM_BLOCK = 16
#: Memory in bytes that one index takes, by ``memory_of``; more items make more indexes, each broadcast in its turn.
INDEX_MEMORY = 256 << 20

# Words are parted by white space and ASCII punctuation, A-Z lower-cased.
_TABLE = LOWER.copy()
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\x0c\r":
    _TABLE[_c] = 32
_TABLE = bytes(_TABLE)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def shingles(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def memory_of(n_words: int, n_bytes: int) -> int:
    """At most how much memory an item takes in an index, in bytes.

    Weights, three sets of shingles and postings are Python objects; measured
    are 1.4 kB a word at English lengths, of which each byte of text is met in
    at most 3 * SHINGLE shingles.
    """
    return 2000 + 1200 * n_words + 3 * SHINGLE * n_bytes


def most_lost(words: list[bytes], weights: dict[bytes, float]) -> float:
    """At most how much weight an item's words have that a passage with OVERLAP of its shingles lacks.

    A missing word takes all shingles that hold it with it, and a shingle holds
    SHINGLE words at most; the heaviest words for their shingles that so many
    missing shingles allow, the last one in part, are an upper bound.
    """
    own = shingles(words, min(SHINGLE, len(words)))
    holding = Counter(w for s in own for w in set(s.split(b" ")))
    left, lost = SHINGLE * int((1 - OVERLAP) * len(own) + 1e-9), 0.0
    for w in sorted(weights, key=lambda w: (-weights[w] / holding[w], w)):
        lost += weights[w] * min(1.0, left / holding[w])
        left -= holding[w]
        if left <= 0:
            break
    return lost


@dataclass
class Statistics:
    """Of all test items, however many indexes hold them: their number, mean length, and in how many a word is."""

    n: int
    mean: float
    df: dict[bytes, int]

    @classmethod
    def of(cls, items: list[list[bytes]]) -> Statistics:
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), Counter(w for ws in items for w in set(ws)))

    def weights(self, words: list[bytes]) -> dict[bytes, float]:
        norm = K1 * (1 - B + B * len(words) / self.mean)
        return {
            w: math.log(1 + (self.n - self.df[w] + 0.5) / (self.df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
            for w, tf in Counter(words).items()
        }


@dataclass
class Item:
    item_id: int
    words: int
    weights: dict[bytes, float]
    need: float
    rest: float
    all: set[bytes]
    question: set[bytes]
    answer: set[bytes]


@dataclass
class Index:
    """Inverted index of test items, for passages as queries.

    Only essential postings are kept: of each item its heaviest terms, as many
    as no passage without any of them could make up for. Postings are grouped
    into blocks of items with the greatest weight of each block. Items meet
    passages of their own size: a block's items share a stride, a power of two
    that is no shorter than they are.
    """

    items: list[Item] = field(default_factory=list)
    #: By stride and word: block, greatest weight, (item, weight).
    postings: dict[int, dict[bytes, list[tuple[int, float, list[tuple[int, float]]]]]] = field(default_factory=dict)
    strides: dict[bytes, tuple[int, ...]] = field(default_factory=dict)
    needs: list[float] = field(default_factory=list)

    @classmethod
    def build(cls, texts: Iterable[tuple[int, str | None]], statistics: Statistics | None = None) -> Index:
        split = [(i, ws) for i, t in texts if (ws := words_of((t or "").encode()))]
        statistics = statistics or Statistics.of([ws for _, ws in split])
        index = cls()
        by_stride: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
        for i, ws in split:
            by_stride[1 << max(5, (len(ws) * 5 // 4 - 1).bit_length())].append((i, ws))
        for stride, members in sorted(by_stride.items()):
            lists: dict[bytes, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
            for at in range(0, len(members), ITEM_BLOCK):
                needs = []
                for item_id, ws in members[at : at + ITEM_BLOCK]:
                    item = index._item(item_id, ws, statistics.weights(ws), lists)
                    needs.append(item.need - item.rest)
                    index.items.append(item)
                index.needs.append(min(needs))
            index.postings[stride] = {w: [(b, max(x for _, x in found), found) for b, found in blocks.items()] for w, blocks in lists.items()}
        for stride, found in index.postings.items():
            for w in found:
                index.strides[w] = (*index.strides.get(w, ()), stride)
        return index

    def _item(self, item_id: int, ws: list[bytes], weights: dict[bytes, float], lists: dict) -> Item:
        """An item, its essential terms put into ``lists``."""
        own, taken = sum(weights.values()), 0.0
        need = own - most_lost(ws, weights)
        for w in sorted(weights, key=lambda w: (-weights[w], w)):
            lists[w][len(self.needs)].append((len(self.items), weights[w]))
            taken += weights[w]
            if own - taken < need - 1e-9:
                break
        width = min(SHINGLE, len(ws))
        cut = max(width, len(ws) * 2 // 3)
        answer = ws[max(0, min(cut, len(ws) - width)) :]
        return Item(item_id, len(ws), weights, need, own - taken, *(shingles(x, width) for x in (ws, ws[:cut], answer)))

    def candidates(self, stride: int, terms: set[bytes]) -> list[int]:
        """Items of a stride that a passage with these essential terms may retrieve."""
        postings = self.postings[stride]
        bounds: dict[int, float] = defaultdict(float)
        for w in terms:
            for block, most, _ in postings[w]:
                bounds[block] += most
        open_blocks = {b for b, x in bounds.items() if x >= self.needs[b] - 1e-9}
        if not open_blocks:
            return []
        sums: dict[int, float] = defaultdict(float)
        for w in terms:
            for block, _, found in postings[w]:
                if block in open_blocks:
                    for k, x in found:
                        sums[k] += x
        return [k for k, x in sums.items() if x + self.items[k].rest >= self.items[k].need - 1e-9]

    def matches(self, text: bytes) -> list[tuple[int, float, float, float, float]]:
        """(item_id, score, overlap, question_overlap, answer_overlap) of every verified item, in the index's order.

        Passages are windows of two strides; any copy of an item lies in one.
        """
        words = words_of(text)
        strides = self.strides
        met: dict[int, dict[int, set[bytes]]] = {s: defaultdict(set) for s in self.postings}
        for i, w in enumerate(words):
            if w in strides:
                for s in strides[w]:
                    met[s][i // s].add(w)
        found: dict[int, tuple[int, float, float, float, float]] = {}
        for stride, here in met.items():
            for b in sorted({*here, *(b - 1 for b in here if b)}):
                if hits := self.candidates(stride, here.get(b, set()) | here.get(b + 1, set())):
                    self._verify(words[b * stride : (b + 2) * stride], hits, found)
        return [found[k] for k in sorted(found)]

    def _verify(self, passage: list[bytes], hits: list[int], found: dict[int, tuple[int, float, float, float, float]]) -> None:
        there, seen = set(passage), {}
        for k in hits:
            it = self.items[k]
            score = sum([it.weights[w] for w in there & it.weights.keys()])
            if score < it.need - 1e-9:
                continue
            width = min(SHINGLE, it.words)
            if width not in seen:
                seen[width] = shingles(passage, width)
            overlap, q, a = (len(s & seen[width]) / len(s) for s in (it.all, it.question, it.answer))
            if overlap >= OVERLAP and (k not in found or score > found[k][1]):
                found[k] = (it.item_id, score, overlap, q, a)


def _split_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = texts_of(batch)
        split = [words_of(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
        memory = [memory_of(len(ws), int(n)) for ws, n in zip(split, np.diff(at))]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(split, pa.list_(pa.binary())), pa.array(memory, pa.int64())], ["item_id", "text", "words", "memory"]
        )


def _shards(benchmark: DataFrame, limit: int) -> Iterator[Index]:
    """Indexes that take at most about ``limit`` bytes of memory each; so does what the driver holds at a time.

    Weights come from statistics of all items, so scores don't depend on how
    many indexes there are. With more than one, the documents are read as often.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").dropDuplicates()
    items = materialize(rows.mapInArrow(frugal(_split_items), "item_id long, text string, words array<binary>, memory long").where(F.size("words") > 0))
    n, mean, memory = items.agg(F.count("*"), F.avg(F.size("words")), F.sum("memory")).first()
    each = items.select("item_id", "text", F.explode(F.array_distinct("words")).alias("word"))
    df = materialize(each.groupBy("word").agg(F.count("*").alias("df")))
    shards = max(1, math.ceil((memory or 0) / limit))
    for k in range(shards):
        here = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k
        part = items.where(here).select("item_id", "text").collect()
        known = each.where(here).select("word").distinct().join(df, "word").collect()
        statistics = Statistics(n, mean or 1.0, {bytes(r[0]): r[1] for r in known})
        yield Index.build(sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), statistics)


def contaminated(docs: DataFrame, benchmark: DataFrame, index_memory: int = INDEX_MEMORY) -> DataFrame:
    """Rows (doc_id, item_id, score, overlap, question_overlap, answer_overlap): a document holds a test item.

    Every passage of every whole text is a BM25 query against the items; all
    that reach the least score that four fifths of an item's five-word shingles
    leave are retrieved and verified: so many of its shingles occur in the
    passage. The overlaps of its first two thirds (the question) and its last
    third (the answer) are reported. ``score`` is the best passage's.

    An item of fewer than five words is met where all of it stands, word for
    word. Null texts hold nothing; null items and items without words match
    nothing. Repeated documents give their rows each time, equal items
    under different ids each match. Empty tables give no rows. Other columns
    are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shard in _shards(benchmark, index_memory):
        index = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = texts_of(batch)
                rows, hits = [], []
                for i in range(len(at) - 1):
                    for hit in index.value.matches(data[at[i] : at[i + 1]].tobytes()):
                        rows.append(i)
                        hits.append(hit)
                columns = list(zip(*hits)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"],
                )

        part = read.mapInArrow(
            run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
        )
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, index_memory: int = INDEX_MEMORY) -> DataFrame:
    """The documents that hold no test item, with all their columns; one pass an index, no join.

    Null and empty texts hold none and stay. Very long texts are searched
    whole. Equal rows go or stay alike; a null item matches nothing. An empty
    table gives no rows, an empty benchmark drops none. Only ``text`` is read,
    other columns pass through whatever their names.
    """
    for shard in _shards(benchmark, index_memory):
        index = docs.sparkSession.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, at = texts_of(batch)
                clean = [not index.value.matches(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
                yield batch.filter(pa.array(np.array(clean, bool)))

        docs = docs.mapInArrow(frugal(run), docs.schema)
    return docs
