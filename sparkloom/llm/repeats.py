"""Removal of long repeats through run-length compressed indexes (operator 6).

A string of 256 bytes brings its anchor with it: the leftmost of the smallest
hashes among its 32-byte grams lies at the same distance from the start wherever
the string occurs. So

1. every text is parted into slices: a slice is a run of starts with one anchor,
   with 400 bytes from its last start on. Only hashes of anchors and digests of
   slices leave the text;
2. anchors that occur once can't repeat. Slices that are alike are one run in
   every column of their transform and are known as repeats without their bytes;
3. where slices of one anchor differ, one of each kind goes to an index: a
   run-length compressed Burrows-Wheeler transform of the slices, aligned at
   their anchors, gives the matching statistics, and what matches is marked;
4. marks are joined per document and cut out.

No group is gathered: an anchor with many different slices is parted by what
lies beside it (strings that share both have some part of that in common), and
what is crowded still is compared string by string, over all tasks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts_of, written

#: Bytes of a string whose repeats are removed.
LENGTH = 400
#: Words of a passage whose repeats are counted, and the least bytes it has.
WORDS, SHORTEST = 50, 256
GRAM = 32
#: Slices that are indexed at a time, about; a task goes through its groups in such lots.
PER_LOT = 2000
#: Slices that are indexed together; a plan parameter that changes no result.
TOGETHER = 128
#: Ways in which the rows of one string are spread.
SALTS = 16
#: Parts of the distances from the anchor by which a crowded anchor is parted.
PARTS = 8

_REACH = SHORTEST - GRAM
_STEP = _REACH // PARTS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.arange(1, 257, dtype=np.uint64) * _MIX
_BYTES = (_BYTES ^ (_BYTES >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Stands for bytes before a slice's first start.
_NONE = 256


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h = _BYTES[data]
    for w in (1, 2, 4, 8, 16):
        h = h[w:] + (h[:-w] << np.uint64(w))
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    w = 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def anchored(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, anchor) of the runs of starts that share an anchor, over all starts of SHORTEST bytes."""
    width = SHORTEST - GRAM + 1
    h = gram_hashes(data)
    least = sliding(h, width)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    last = np.append(first[1:], len(least)) - 1
    anchor = first + np.lib.stride_tricks.sliding_window_view(h, width)[first].argmin(axis=1)
    more = np.flatnonzero(last > anchor)
    if len(more):
        # The smallest hash comes again within the run: each place of it anchors the starts up to it.
        cuts = []
        for a, b in zip(first[more].tolist(), last[more].tolist()):
            places = np.flatnonzero(h[a:b] == least[a]) + a + 1
            cuts.append(places[places <= b])
        first = np.union1d(first, np.concatenate(cuts))
        last = np.append(first[1:], len(least)) - 1
        anchor = first + np.lib.stride_tricks.sliding_window_view(h, width)[first].argmin(axis=1)
    return least[first], first, last, anchor


def slices(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, digest, first, shape, upto) of the slices of a text.

    ``shape`` holds how far the last start and the anchor are from the first.
    Slices alike in a row, as periodic texts have them, are one: ``upto`` is
    the last start of all.
    """
    if len(data) < SHORTEST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.int32),) * 3
    value, first, last, anchor = anchored(data)
    ends = np.minimum(last + LENGTH, len(data))
    opens = np.concatenate([[True], _SPACE[data[first[1:] - 1]]])
    seeds = (last - first) * 2 + opens
    view = memoryview(np.ascontiguousarray(data))
    digest = xxhash.xxh3_64_intdigest
    digests = np.array([digest(view[a:b], s) for a, b, s in zip(first.tolist(), ends.tolist(), seeds.tolist())], np.uint64).view(np.int64)
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (digests[1:] != digests[:-1])])
    upto = last[np.append(np.flatnonzero(new)[1:], len(new)) - 1]
    shape = (last - first) << 9 | (anchor - first)
    return value.view(np.int64)[new], digests[new], *(x.astype(np.int32) for x in (first[new], shape[new], upto))


def long_words(text: np.ndarray, opens: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the strings of WORDS whole words, from SHORTEST to less than LENGTH bytes.

    ``opens``: a word may begin at the first byte. Words are parted by ASCII white space.
    """
    space = np.concatenate([[opens], _SPACE[text], [True]])
    begins = np.flatnonzero(space[:-2] & ~space[1:-1])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    if len(begins) < len(ends):  # the text starts within a word
        ends = ends[1:]
    starts, stops = begins[: max(0, len(begins) - WORDS + 1)], ends[WORDS - 1 :]
    fits = (stops - starts >= SHORTEST) & (stops - starts < LENGTH)
    return starts[fits], stops[fits]


class RunIndex:
    """Run-length compressed transform of slices that are aligned at their anchors.

    Every byte is told apart by its distance from the anchor, so the rows of
    the Burrows-Wheeler transform come in columns: those of the suffixes that
    start ``a`` bytes before the anchor, in suffix order. The column of ``a + 1``
    follows from that of ``a`` by a stable sort on the preceding byte.
    Neighbours with the same preceding byte match one byte more in the next
    column, as neighbours too. So match lengths are kept only where a run of a
    column ends; all others follow from these in text order, each one less than
    that before it. Only the run ends stay in memory, never a suffix order.

    ``group``: slices with different numbers don't match; ``left`` holds the
    bytes before the anchor, nearest first, ``right`` those from it on, both
    padded by 256; ``copies``: how often a slice occurs.
    """

    def __init__(self, group: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray):
        self.shape = (len(group), left.shape[1] + 1)
        self.rows, self.columns, self.match = [], [], []
        self.runs = 0
        # A slice that occurs twice matches as far as it goes.
        twice = np.flatnonzero(copies > 1)
        held = (left != _NONE).sum(axis=1)
        self._keep(twice, held[twice], ((right != _NONE).sum(axis=1) + held)[twice])
        left = np.column_stack([left, np.full(len(group), _NONE, left.dtype)])
        text = right.astype(">u2").view(f"S{2 * right.shape[1]}").ravel()
        order = np.lexsort((text, group))
        differ = (right[order[1:]] != right[order[:-1]]) | (right[order[1:]] == _NONE)
        match = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])])
        number = group[order]
        parted = np.concatenate([[True], number[1:] != number[:-1]])
        number = np.cumsum(parted) * (_NONE + 1)
        match[parted] = 0
        for a in range(left.shape[1]):
            before = left[order, a]
            ends = (before[1:] != before[:-1]) | (before[1:] == _NONE) | parted[1:]
            self.runs += int(ends.sum()) + 1
            k = np.flatnonzero(ends & (match[1:] > 0)) + 1
            self._keep(order[k - 1], a, match[k])
            self._keep(order[k], a, match[k])
            if (before == _NONE).all():
                break
            order, match = self._next(order, match, number, before)
        self.rows, self.columns, self.match = (np.concatenate(x) for x in (self.rows, self.columns, self.match))

    def _keep(self, rows: np.ndarray, column: np.ndarray | int, match: np.ndarray) -> None:
        self.rows.append(rows)
        self.columns.append(np.broadcast_to(column, len(rows)))
        self.match.append(match)

    @staticmethod
    def _next(order: np.ndarray, match: np.ndarray, number: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = number + before
        to = np.argsort(key, kind="stable")
        key = key[to]
        same = (key[1:] == key[:-1]) & (before[to[1:]] != _NONE)
        near = same & (to[1:] == to[:-1] + 1)
        new = np.zeros_like(match)
        at = np.flatnonzero(near) + 1
        new[at] = match[to[at]] + 1
        far = np.flatnonzero(same & ~near) + 1
        if len(far):
            # The least match on the way from one to the other, by a table of powers of two.
            lo, hi = to[far - 1] + 1, to[far] + 1
            level = np.frexp(hi - lo)[1] - 1
            least, table = match, np.empty(len(far), match.dtype)
            for w in range(int(level.max()) + 1):
                if w:
                    least = np.minimum(least[: -(1 << (w - 1))], least[1 << (w - 1) :])
                here = level == w
                table[here] = np.minimum(least[lo[here]], least[hi[here] - (1 << w)])
            new[far] = table + 1
        return order[to], new

    def matching_statistics(self) -> np.ndarray:
        """For each slice and distance before its anchor the longest match elsewhere, streamed in text order from the run ends."""
        reach = np.full(self.shape, -(1 << 20), np.int32)
        np.maximum.at(reach, (self.rows, self.columns), (self.match - self.columns).astype(np.int32))
        reach = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]
        return np.maximum(reach + np.arange(self.shape[1], dtype=np.int32), 0)


def _aligned(blobs: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each anchor, nearest first, and from it on; the first byte of a blob is not the slice's."""
    sizes = np.array([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = (begin + 1 + anchors)[:, None]

    def taken(places: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, data[np.where(there, places, 0)], np.uint16(_NONE)).astype(np.uint16)

    back = at - 1 - np.arange(max(1, int(anchors.max())))
    on = at + np.arange(LENGTH)
    return taken(back, back > begin[:, None]), taken(on, on < (begin + sizes)[:, None])


def _runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    yield from zip(edges[::2].tolist(), edges[1::2].tolist())


def repeated(group: np.ndarray, blobs: list[bytes], shapes: np.ndarray, copies: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(slice, kind, start, end) of what repeats, from each slice's first start on.

    Kind 0: strings of LENGTH bytes; kind 1: strings of WORDS words that are shorter.
    """
    lasts, anchors = shapes >> 9, shapes & 511
    index = RunIndex(group, *_aligned(blobs, anchors), copies)
    match = index.matching_statistics()
    out, passages = [], []
    met = match >= SHORTEST
    for i in np.flatnonzero(met.any(axis=1)).tolist():
        own = match[i, anchors[i] - lasts[i] : anchors[i] + 1][::-1]
        out += [(i, 0, a, b - 1 + LENGTH) for a, b in _runs(own >= LENGTH)]
        if (own >= SHORTEST).any():
            blob = blobs[i]
            for a, b in zip(*long_words(np.frombuffer(blob, np.uint8)[1:], bool(_SPACE[blob[0]]))):
                if a <= lasts[i] and own[a] >= b - a:
                    passages.append((i, int(a), int(b)))
    # The same words, as words, elsewhere.
    times: Counter = Counter()
    keys = [(int(group[i]), blobs[i][1 + a : 1 + b]) for i, a, b in passages]
    for (i, _, _), key in zip(passages, keys):
        times[key] += int(copies[i])
    return out + [(i, 1, a, b) for (i, a, b), key in zip(passages, keys) if times[key] > 1]


_SLICES = "uid binary, hashes array<long>, digests array<long>, firsts array<int>, shapes array<int>, uptos array<int>"


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = texts_of(batch)
        found = [slices(data[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]), pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in zip(*found)] if found else []
        if found:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["uid", "hashes", "digests", "firsts", "shapes", "uptos"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, at = texts_of(batch)
        packed = [pack(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "packed"])


_WANTED = "key long, part int, hash long, digest long, n long, shape int, bytes binary"


def _fetched(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted slices, with the key under which they meet others."""
    unpack, digest = zstandard.ZstdDecompressor().decompress, xxhash.xxh3_64_intdigest
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = b" " + unpack(packed)
            for w in wanted:
                first, last, anchor = w["first"], w["shape"] >> 9, w["shape"] & 511
                blob = text[first : first + last + LENGTH + 1]
                keys = [(w["hash"], -1)]
                if w["m"] > together:
                    at = 1 + anchor
                    keys = []
                    for part in range(PARTS):
                        a, b = at - part * _STEP, at + SHORTEST - (part + 1) * _STEP
                        if a >= 1 and b <= len(blob):
                            keys.append((digest(blob[a:b], part) - (1 << 63), part))
                for key, part in keys:
                    for c, v in zip(columns, (key, part, w["hash"], w["digest"], w["n"], w["shape"], blob)):
                        c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "part", "hash", "digest", "n", "shape", "bytes"])


_MARK = "hash long, digest long, kind int, start int, end int"


def _index_lot(lot: pa.Table) -> pa.RecordBatch:
    pdf = lot.to_pandas().drop_duplicates(["key", "part", "hash", "digest"], ignore_index=True)
    group = pdf.groupby(["key", "part"], sort=False).ngroup().to_numpy()
    found = repeated(group, pdf["bytes"].tolist(), pdf["shape"].to_numpy(), pdf["n"].to_numpy())
    at = np.array([f[0] for f in found], int)
    rest = np.array([f[1:] for f in found], np.int32).reshape(len(found), 3)
    columns = [pdf["hash"].to_numpy()[at], pdf["digest"].to_numpy()[at], rest[:, 0], rest[:, 1], rest[:, 2]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "digest", "kind", "start", "end"])


def _index_batches(batches: Iterator[pa.RecordBatch], per_lot: int) -> Iterator[pa.RecordBatch]:
    """Marks of a partition's groups, which follow each other and are small: a lot ends with the last whole group."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) < per_lot:
            continue
        key, part = held["key"].to_numpy(), held["part"].to_numpy()
        opens = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        begin = 0
        for at in opens.tolist():
            if at - begin >= per_lot or (at == opens[-1] and at > begin):
                yield _index_lot(held.slice(begin, at - begin))
                begin = at
        held = held.slice(begin)
    if held is not None and len(held):
        yield _index_lot(held)


_STRINGS = f"string binary, n long, {_MARK}"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string of a slice whose start is so far from the anchor as its part says."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        strings, times, of, rows = [], [], [], batch.to_pylist()
        for k, row in enumerate(rows):
            blob, last, anchor, part = row["bytes"], row["shape"] >> 9, row["shape"] & 511, row["part"]
            lo = max(0, anchor - (_REACH if part == PARTS - 1 else (part + 1) * _STEP - 1))
            hi = min(last, anchor - part * _STEP)
            spans = [(0, s, s + LENGTH) for s in range(lo, min(hi + 1, len(blob) - LENGTH))]
            spans += [(1, int(a), int(b)) for a, b in zip(*long_words(np.frombuffer(blob, np.uint8)[1:], bool(_SPACE[blob[0]]))) if lo <= a <= hi]
            strings += [digest(blob[1 + a : 1 + b], kind) for kind, a, b in spans]
            times += [min(row["n"], 2)] * len(spans)
            of += [(k, *span) for span in spans]
        at, kind, start, end = np.array(of, np.int64).reshape(len(of), 4).T
        columns = [pa.array(strings, pa.binary()), pa.array(times, pa.int64()), *(batch.column(c).take(pa.array(at)) for c in ("hash", "digest"))]
        columns += [pa.array(x.astype(np.int32)) for x in (kind, start, end)]
        yield pa.RecordBatch.from_arrays(columns, ["string", "n", "hash", "digest", "kind", "start", "end"])


def _cut(text: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int, int, str, int, int]:
    """n_bytes, n_removed, n_spans, kept_sha256, n_passages and passage_bytes of a text with these marks."""
    end = np.minimum(end, len(text))
    whole = kind == 2
    short = whole & (end - start < LENGTH)
    if short.any():
        # Slices that repeat whole but are short: the words in them.
        a, b = long_words(text)
        lo, hi = np.searchsorted(a, start[short]), np.searchsorted(b, end[short], "right")
        within = np.unique(np.concatenate([np.arange(x, max(x, y)) for x, y in zip(lo, hi)]))
        more = (a[within], b[within])
    else:
        more = (np.zeros(0, np.int64),) * 2

    def covered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(text) + 1
        return np.cumsum(np.bincount(starts, minlength=n)[:-1] - np.bincount(ends, minlength=n)[:-1]) > 0

    def runs(mask: np.ndarray) -> int:
        return int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())

    long = ~short & (kind != 1)
    gone = covered(start[long], end[long])
    also = gone | covered(np.concatenate([start[kind == 1], more[0]]), np.concatenate([end[kind == 1], more[1]]))
    return len(text), int(gone.sum()), runs(gone), hashlib.sha256(text[~gone].tobytes()).hexdigest(), runs(also), int(also.sum())


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        marks = batch.column(2)
        flat = marks.flatten()
        kind, start, end = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("kind", "start", "end"))
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False))])
        for i, packed in enumerate(batch.column(1).to_pylist()):
            text, here = unpack(packed), slice(at[i], at[i + 1])
            if at[i] == at[i + 1]:
                row = (len(text), 0, 0, hashlib.sha256(text).hexdigest(), 0, 0)
            else:
                row = _cut(np.frombuffer(text, np.uint8), kind[here], start[here], end[here])
            for c, v in zip(columns, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"],
        )


def marks(texts: DataFrame, packed: DataFrame, per_lot: int = PER_LOT, together: int = TOGETHER) -> DataFrame:
    """(uid, marks): per text the (start, end, kind) of what repeats, which may overlap; materialised.

    ``texts`` has (uid, text), ``packed`` the same texts compressed. ``uid`` is a
    digest of the text: copies share it and their marks, and count as often as
    they occur. Kinds are those of ``repeated``; 2 is a slice that repeats whole.
    """
    made, drop_made = written(texts.mapInArrow(_slice_batches, _SLICES))
    each = made.select("uid", F.explode(F.arrays_zip("hashes", "digests", "firsts", "shapes", "uptos")).alias("e")).select(
        "uid", F.col("e.hashes").alias("hash"), F.col("e.digests").alias("digest"), F.col("e.firsts").alias("first"),
        F.col("e.shapes").alias("shape"), F.col("e.uptos").alias("upto"),
    )
    periods = F.when(F.col("upto") - F.col("first") > F.shiftright("shape", 9), 2).otherwise(1)
    often_met = materialize(each.groupBy("hash").agg(F.sum(periods).alias("n")).where("n > 1").select("hash"))
    # Written out, so that the join deals both sides anew and a hot anchor's rows can be split.
    known, drop_known = written(each.join(often_met, "hash"))
    alike = materialize(
        known.groupBy("hash", "digest").agg(F.sum(periods).alias("n"), F.min(F.struct("uid", "first")).alias("at"), F.first("shape").alias("shape"))
    )
    kinds = materialize(alike.groupBy("hash").agg(F.count("*").alias("m")).where("m > 1"))
    wanted = (
        alike.join(kinds, "hash")
        .groupBy(F.col("at.uid").alias("uid"))
        .agg(F.collect_list(F.struct("hash", "digest", "n", "m", F.col("at.first").alias("first"), "shape")).alias("wanted"))
    )
    one_each = packed.groupBy("uid").agg(F.first("packed").alias("packed"))
    met, drop_met = written(
        one_each.join(wanted, "uid").select("packed", "wanted").mapInArrow(lambda batches: _fetched(batches, together), _WANTED)
    )
    # A slice that occurs twice repeats even where no other kind lies beside it.
    crowds = materialize(
        met.where("part >= 0").groupBy("key", "part").agg(F.count("*").alias("of"), F.sum("n").alias("times")).where("times > 1").drop("times")
    )
    parted = met.where("part >= 0").join(crowds, ["key", "part"])
    together_now = met.where("part < 0").unionByName(parted.where(F.col("of") <= together).drop("of"))
    # Groups are small, so any partition of them is even; each lies together after the sort.
    indexed = (
        together_now.repartition("key", "part").sortWithinPartitions("key", "part")
        .mapInArrow(lambda batches: _index_batches(batches, per_lot), _MARK)
    )
    strings = materialize(parted.where(F.col("of") > together).drop("of").mapInArrow(_strings, _STRINGS))
    often = materialize(strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string"))
    # A string may stand in any share of all slices: its rows are spread by a salt.
    salted = often.select("string", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    compared = (
        strings.withColumn("salt", F.pmod("digest", F.lit(SALTS)).cast("int")).join(salted, ["string", "salt"])
        .select("hash", "digest", "kind", "start", "end")
    )
    # A slice of an anchor without other kinds is known whole.
    whole = alike.where("n > 1").join(kinds, "hash", "left_anti").select(
        "hash", "digest", F.lit(2).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end")
    )
    found = materialize(
        whole.unionByName(indexed).unionByName(compared)
        .groupBy("hash", "digest").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans"))
    )
    placed = known.join(found, ["hash", "digest"]).select("uid", "first", "shape", "upto", F.explode("spans").alias("m"))
    # Of slices alike in a row all are marked: each repeats in the next.
    all_of_it = (F.col("m.kind") == 2) | (F.col("upto") - F.col("first") > F.shiftright("shape", 9))
    spans = placed.select(
        "uid",
        F.when(all_of_it, F.col("first")).otherwise(F.col("first") + F.col("m.start")).alias("start"),
        F.when(all_of_it, F.col("upto") + LENGTH).otherwise(F.col("first") + F.col("m.end")).alias("end"),
        F.when(all_of_it, 2).otherwise(F.col("m.kind")).alias("kind"),
    )
    per = materialize(spans.groupBy("uid").agg(F.collect_set(F.struct("start", "end", "kind")).alias("marks")))
    for drop in (drop_made, drop_known, drop_met):
        drop()
    return per


def remove_repeats(docs: DataFrame, per_lot: int = PER_LOT, together: int = TOGETHER) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes.

    Every byte of the UTF-8 text that a 400-byte string covers which also
    starts anywhere else, in this or another document, is removed; strings are
    judged on the input. n_spans counts the maximal removed runs, kept_sha256
    is of what remains.

    n_passages and passage_bytes also cover shorter repeats that aren't
    removed: strings of 50 whole words, of 256 bytes at least, that occur
    elsewhere as the same words with the same white space between.

    Null text counts as empty; texts under 256 bytes lose and count nothing.
    Repeated rows are documents of their own, so they repeat each other. An
    empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    numbered = docs.select(
        F.unhex(F.md5(text.cast("binary"))).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")
    )
    packed = numbered.mapInArrow(_packed, "uid binary, doc_id long, packed binary")
    per = marks(numbered.select("uid", "text"), packed.select("uid", "packed"), per_lot, together)
    return (
        packed.join(per, "uid", "left")
        .select("doc_id", "packed", "marks")
        .mapInArrow(
            _cut_batches,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long",
        )
    )
