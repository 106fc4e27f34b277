"""Alignment of two tokenizers' tokens by a sweep over their ends (operator 13)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts_of, written
from .packing import vocabulary

#: Units whose ids a Python worker remembers; when there are more it starts anew.
REMEMBERED = 500_000
#: Bytes of texts whose units are looked up at once, and of new units that are encoded as one text.
TOGETHER, LEARNT_AT_ONCE = 8 << 20, 1 << 16
#: Bytes of text whose end events travel in one row.
WINDOW = 1 << 16
#: Tokens that the sweep takes in at once.
AT_ONCE = 1 << 20
#: Id pairs whose counts a task holds at a time; with more, links are looked up in as many passes as needed.
PAIRS = 1 << 22


class Vocabulary:
    """A tokenizer without special tokens: ids of texts that each begin with a space, and the bytes of every id."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; threads of the tokenizer's own would take cores from other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.tokens = [_piece_bytes(model, i) for i in range(model.get_piece_size())]
            self.encode: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
            alone = model.piece_to_id("▁")
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            letters = _byte_letters()
            vocabulary = model.get_vocab()
            self.tokens = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            alone = model.token_to_id("Ġ")
        # A text without its leading space would be no text to a model that adds it.
        self.known: dict[bytes, bytes | None] = {b" ": np.array([alone], "<u4").tobytes()}
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))

    def checked(self, texts: list[bytes]) -> list[bytes | None]:
        """Little-endian 32-bit ids of each text; none if their bytes, joined, aren't the text."""
        out: list[bytes | None] = []
        tokens = self.tokens
        for text, ids in zip(texts, self.encode([t.decode("utf-8", "replace") for t in texts])):
            out.append(np.array(ids, "<u4").tobytes() if b"".join([tokens[i] for i in ids]) == text else None)
        return out

    def _learnt(self, units: list[bytes]) -> list[bytes | None]:
        """Ids of units. Those that end in a visible ASCII character are encoded as one text, which is cut behind them."""
        out: list[bytes | None] = [None] * len(units)
        alone = [i for i, u in enumerate(units) if not 32 < u[-1] < 127]
        rest = [i for i, u in enumerate(units) if 32 < u[-1] < 127]
        sizes = np.fromiter((len(units[i]) for i in rest), np.int64, len(rest))
        parts = np.cumsum(sizes) // LEARNT_AT_ONCE
        for part in np.split(np.arange(len(rest)), np.flatnonzero(np.diff(parts)) + 1):
            members = [rest[k] for k in part.tolist()]
            ids = self.checked([b"".join([units[i] for i in members])])[0] if members else None
            if ids is None:
                alone += members
                continue
            ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
            at = np.searchsorted(ends, np.cumsum(sizes[part]), "right").tolist()
            begin = 0
            for i, end in zip(members, at):
                out[i] = ids[4 * begin : 4 * end]
                begin = end
        for i, ids in zip(alone, self.checked([units[i] for i in alone])):
            out[i] = ids
        return out

    def units(self, units: list[bytes]) -> list[bytes | None]:
        """Ids of distinct units, learnt where they aren't remembered."""
        known = self.known
        found = [known.get(u, 0) for u in units]
        fresh = [u for u, x in zip(units, found) if x == 0]
        if not fresh:
            return found
        if len(known) + len(fresh) > REMEMBERED:
            known = self.known = {b" ": known[b" "]}
            fresh = [u for u in units if u != b" "]
        known.update(zip(fresh, self._learnt(fresh)))
        return list(map(known.get, units))

    def of(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of texts that begin with a space; none where their bytes, joined, aren't the text.

        No token of either kind goes on from a visible character to a space, so
        a text is cut before such spaces and the ids are those of its units in turn.
        """
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        cuts = _cuts(data, at[:-1])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)])
        words = whole.dictionary_encode()
        ids = self.units(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        bad = np.fromiter((x is None for x in ids), bool, len(ids))
        if bad.any():
            ids = [x or b"" for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        nth = words.indices.to_numpy()
        n = sizes[nth]
        ends = np.cumsum(n, dtype=np.int64)
        place = np.repeat((np.cumsum(sizes, dtype=np.int64) - sizes)[nth] - ends + n, n)
        place += np.arange(len(place))
        placed = flat[place]
        edges = np.concatenate([[0], ends])[np.searchsorted(cuts, at)]
        out: list[np.ndarray | None] = [placed[a:b] for a, b in zip(edges, edges[1:])]
        for i in np.unique(np.searchsorted(at, cuts[bad[nth]], "right") - 1).tolist():
            ids = self.checked([texts[i]])[0]
            out[i] = None if ids is None else np.frombuffer(ids, "<u4")
        return out


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 ones are themselves, the rest follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The begins of texts, and places of spaces after a visible ASCII character or one of U+00C0 to U+027F."""
    space = data == 32
    visible = (data > 32) & (data < 127)
    visible[1:] |= ((data[1:] & 0xC0) == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)
    space[1:] &= visible[:-1]
    space[begins] = True
    return np.flatnonzero(space)


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """The tokenizer of a path; a worker keeps the ids of one tokenizer's units at a time."""
    for other, loaded in _loaded.items():
        if other != path:
            loaded.known = {b" ": loaded.known[b" "]}
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def end_events(docs: DataFrame, path: str, side: int) -> DataFrame:
    """Where the tokens of space+text end, in rows of the events of one document and window of the text.

    doc_id, raw (a hash of the text), size (its bytes), window, side, ok, and
    ids of the tokens that end in the window; the ends follow from the ids.
    Documents without tokens have one row that isn't ok.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _vocabulary(path)
        width = np.dtype("<u2" if len(model.tokens) <= 1 << 16 else "<u4")
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, at = texts_of(batch)
            k = 0
            while k < batch.num_rows:
                m = max(k + 1, int(np.searchsorted(at, at[k] + TOGETHER, "right")) - 1)
                texts = [data[at[i] : at[i + 1]].tobytes() for i in range(k, m)]
                there = [i for i, t in enumerate(texts) if t]
                ids = dict(zip(there, model.of([b" " + texts[i] for i in there]))) if there else {}
                rows = []
                for i, t in enumerate(texts):
                    raw, own = xxhash.xxh3_64_intdigest(t) - (1 << 63), ids.get(i)
                    if own is None:
                        rows.append((k + i, raw, len(t) + 1, 0, False, b""))
                        continue
                    windows = (np.cumsum(model.lengths[own]) - 1) // WINDOW
                    edges = np.searchsorted(windows, np.arange(windows[-1] + 2)).tolist()
                    rows += [(k + i, raw, len(t) + 1, w, True, pack(own[a:b].astype(width).tobytes())) for w, (a, b) in enumerate(zip(edges, edges[1:]))]
                nth, raws, sizes, windows, ok, packed = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(nth)), pa.array(raws, pa.int64()), pa.array(sizes, pa.int64()), pa.array(windows, pa.int32()), pa.array([side] * len(nth), pa.int32()), pa.array(ok), pa.array(packed, pa.binary())],
                    ["doc_id", "raw", "size", "window", "side", "ok", "ids"],
                )
                k = m

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, raw long, size long, window int, side int, ok boolean, ids binary")


@dataclass
class Spans:
    """Tokens of two sides over the same bytes, from one common end to another: what the sweep and the links are read off."""

    ids: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        marks = np.zeros(max((int(e[-1]) + 1 if len(e) else 1 for e in self.ends)), np.uint8)
        for side, ends in enumerate(self.ends):
            marks[ends] |= side + 1
        #: Every end; between two of them lies one link.
        self.at = np.flatnonzero(marks)
        kinds = marks[self.at]
        self.is_a, self.is_b, self.common = (kinds & 1) > 0, kinds > 1, kinds == 3
        self.n_a, self.n_b = np.cumsum(self.is_a), np.cumsum(self.is_b)

    def pairs(self, factor: int) -> np.ndarray:
        """For every link the A id times ``factor`` plus the B id."""
        a, b = self.ids[0][self.n_a - self.is_a], self.ids[1][self.n_b - self.is_b]
        return a.astype(np.int64) * factor + b


#: Columns of a piece of a document, from one group's begin to another's end.
PIECES = "doc_id long, raw long, times long, last boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_a binary, ids_b binary"


@dataclass
class Sweep:
    """Reads end events in order of document and offset and tells where both sides end.

    What it keeps between rows is bounded by a window: the tokens since the
    last common end, and of the open document its place and its running hash.
    """

    lengths: tuple[np.ndarray, np.ndarray]
    #: Names of all ids of A, then of B, see ``_names``.
    names: pa.Array
    #: Tokens not yet given out, from a common end on.
    waiting: list[list[np.ndarray]] = field(default_factory=lambda: [[], []])
    tokens: int = 0
    #: Documents whose last end isn't given out yet: [doc_id, raw, times, bytes left].
    open: list[list] = field(default_factory=list)
    sha: object = field(default_factory=hashlib.sha256)
    key: tuple | None = None
    held: tuple | None = None
    last: tuple | None = None
    dead: bool = False

    def add(self, doc_id: int | None, raw: int, size: int, window: int, side: int, ok: bool, ids: bytes, unpack: Callable[[bytes], bytes]) -> list | None:
        """Take in one row; returns the document if it has no tokens, once."""
        if (doc_id, raw) != self.key:
            self.key, self.dead, self.last, self.held = (doc_id, raw), False, None, None
            self.document = [doc_id, raw, 0, size]
        if (window, side) == (0, 0):
            self.document[2] += 1
        if (window, side) == self.last:
            return None  # an equal row of the table
        self.last = (window, side)
        if side == 0:
            self.held = (ok, ids)
            return None
        if self.dead or not (ok and self.held[0]):
            gone, self.dead = not self.dead, True
            return self.document if gone else None
        if window == 0:
            self.open.append(self.document)
        for s, x in enumerate((self.held[1], ids)):
            width = np.dtype("<u2" if len(self.lengths[s]) <= 1 << 16 else "<u4")
            self.waiting[s].append(np.frombuffer(unpack(x), width))
            self.tokens += len(self.waiting[s][-1])
        return None

    def flush(self) -> list[tuple]:
        """A row of PIECES for each document, up to the last common end."""
        ids = [np.concatenate(w) if w else np.zeros(0, np.uint16) for w in self.waiting]
        spans = Spans(tuple(ids), tuple(np.cumsum(n[i]) for n, i in zip(self.lengths, ids)))
        common = np.flatnonzero(spans.common)
        if not len(common):
            return []
        k, ends = common[-1] + 1, spans.at[common]
        upto = [int(spans.n_a[k - 1]), int(spans.n_b[k - 1])]
        self.waiting = [[i[n:]] for i, n in zip(ids, upto)]
        self.tokens = sum(len(w[0]) for w in self.waiting)
        # Names in order of groups, those of A before those of B, each with what follows it.
        groups = np.cumsum(spans.common) - spans.common
        n_a, n_b = spans.n_a[common], spans.n_b[common]
        text = np.empty(sum(upto), np.int64)
        for s, (is_s, before) in enumerate(((spans.is_a, np.append(0, n_b[:-1])), (spans.is_b, n_a))):
            kind = np.zeros(upto[s], np.int64)
            kind[(n_a if s == 0 else n_b) - 1] = s + 1
            chosen = ids[s][: upto[s]] * np.int64(3) + kind + s * 3 * len(self.lengths[0])
            text[np.arange(upto[s]) + before[groups[:k][is_s[:k]]]] = chosen
        named = self.names.take(pa.array(text))
        offsets = np.frombuffer(named.buffers()[1], np.int64)[: len(text) + 1]
        letters = memoryview(named.buffers()[2]) if len(text) else memoryview(b"")
        # Documents end where their bytes do.
        edges = np.minimum(np.cumsum([d[3] for d in self.open]), ends[-1])
        upto_group = np.searchsorted(ends, edges, "right")
        rows, a = [], 0
        begin = (0, 0, 0)
        while self.open and a < len(edges):
            document, g = self.open[a], int(upto_group[a])
            stop = (int(n_a[g - 1]), int(n_b[g - 1]), int(common[g - 1]) + 1) if g else begin
            size = int(edges[a]) - (int(edges[a - 1]) if a else 0)
            if size == 0:
                break
            done = size == document[3]
            self.sha.update(letters[offsets[begin[0] + begin[1]] : offsets[stop[0] + stop[1]] - done])
            before = int(upto_group[a - 1]) if a else 0
            rows.append((
                *document[:3], done, stop[0] - begin[0], stop[1] - begin[1], g - before, stop[2] - begin[2], self.sha.hexdigest() if done else "",
                ids[0][begin[0] : stop[0]].tobytes(), ids[1][begin[1] : stop[1]].tobytes(),
            ))
            begin = stop
            if not done:
                document[3] -= size
                break
            self.sha = hashlib.sha256()
            a += 1
        self.open = self.open[a:]
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _names(model: Vocabulary, end: str) -> list[str]:
    """Decimal ids, each three times: with a comma, and with what ends the ids of a side in a group."""
    return [f"{i}{x}" for i in range(len(model.tokens)) for x in (",", end, end)]


def pieces(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Every document in pieces of whole groups: see PIECES; ``ids_a`` and ``ids_b`` cover the same bytes.

    The end events of both sides are united, dealt out by document and sorted
    by offset; one pass over them finds the ends that both sides share. Of
    equal rows of the table one is swept, ``times`` tells how many there are;
    it is right in a document's last piece.
    """
    events = end_events(docs, a_path, 0).unionByName(end_events(docs, b_path, 1))
    order = ("doc_id", "raw", "window", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _vocabulary(a_path), _vocabulary(b_path)
        sweep = Sweep(tuple(m.lengths for m in models), pa.array(_names(models[0], "|") + _names(models[1], ";"), pa.large_string()))
        unpack = zstandard.ZstdDecompressor().decompress
        empty: list[list] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if sweep.tokens >= AT_ONCE and row[:2] != sweep.key or sweep.tokens >= 4 * AT_ONCE and row[4] == 0 and row[3:5] != sweep.last:
                    if rows := sweep.flush():
                        yield _batch(rows)
                if (document := sweep.add(*row, unpack)) is not None:
                    empty.append(document)
            if sweep.key is not None and len(empty) > 1000:
                done, empty = [d for d in empty if tuple(d[:2]) != sweep.key], [d for d in empty if tuple(d[:2]) == sweep.key]
                if done:
                    yield _batch([(*d[:3], True, 0, 0, 0, 0, "", b"", b"") for d in done])
        if rows := sweep.flush():
            yield _batch(rows)
        if empty:
            yield _batch([(*d[:3], True, 0, 0, 0, 0, "", b"", b"") for d in empty])

    return events.repartition("doc_id", "raw").sortWithinPartitions(*order).mapInArrow(run, PIECES)


def _spans_of(batch: pa.RecordBatch, lengths: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, Spans, np.ndarray]]:
    """From the columns ids_a and ids_b: rows from, to, their tokens as those of one text, and where in it each row ends."""
    columns = [batch.column(batch.schema.get_field_index(f"ids_{s}")) for s in "ab"]
    sizes = np.cumsum([0] + [len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(*columns)])
    k = 0
    while k < batch.num_rows:
        m = max(k + 1, int(np.searchsorted(sizes, sizes[k] + 2 * AT_ONCE, "right")) - 1)
        parts = [[np.frombuffer(x.as_buffer(), "<u2" if len(n) <= 1 << 16 else "<u4") for x in c.slice(k, m - k)] for c, n in zip(columns, lengths)]
        ids = tuple(np.concatenate(p) for p in parts)
        ends = tuple(np.cumsum(n[i]) for n, i in zip(lengths, ids))
        counts = np.cumsum([len(p) for p in parts[0]])
        yield k, m, Spans(ids, ends), np.where(counts > 0, np.append(0, ends[0])[counts], 0)
        k = m


def links(made: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_id, b_id, start and end of every link in ``pieces``; offsets are of bytes within the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _vocabulary(a_path), _vocabulary(b_path)
        factor = len(models[1].tokens)
        for batch in batches:
            for k, m, spans, edges in _spans_of(batch, tuple(x.lengths for x in models)):
                if not len(spans.at):
                    continue
                row = np.searchsorted(edges, spans.at)
                pairs, base = spans.pairs(factor), np.append(0, edges[:-1])[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, m - k).take(pa.array(row)), *map(pa.array, (pairs // factor, pairs % factor, np.append(0, spans.at[:-1]) - base, spans.at - base))],
                    ["doc_id", "a_id", "b_id", "start", "end"],
                )

    return made.select("doc_id", "ids_a", "ids_b").mapInArrow(run, "doc_id long, a_id long, b_id long, start long, end long")


def pair_counts(made: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count (how many links hold the pair) and best (whether it is its B id's highest) of every id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _vocabulary(a_path), _vocabulary(b_path)
        for batch in batches:
            times = batch.column(0).to_numpy()
            for k, m, spans, edges in _spans_of(batch, tuple(x.lengths for x in models)):
                if not len(spans.at):
                    continue
                pairs = spans.pairs(len(models[1].tokens))
                weights = times[k:m][np.searchsorted(edges, spans.at)]
                found, nth = np.unique(pairs, return_inverse=True)
                counts = np.bincount(nth, weights).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["pair", "n"])

    factor = len(_vocabulary(b_path).tokens)
    counted = made.select("times", "ids_a", "ids_b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))
    split = counted.select(F.floor(F.col("pair") / factor).alias("a_id"), F.pmod("pair", F.lit(factor)).alias("b_id"), "count")
    most = split.groupBy("b_id").agg(F.max("count").alias("most"))
    return split.join(most, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def _looked_up(made: DataFrame, counts: DataFrame, a_path: str, b_path: str, part: int, parts: int) -> DataFrame:
    """Of every piece n_best and count_sum, over the links whose pair is in one part of the counts."""
    factor = len(_vocabulary(b_path).tokens)
    keyed = counts.select((F.col("a_id") * factor + F.col("b_id")).alias("pair"), "count", "best")
    here = keyed.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow()
    order = np.argsort(here["pair"].to_numpy())
    table = made.sparkSession.sparkContext.broadcast(tuple(here[c].to_numpy()[order] for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _vocabulary(a_path), _vocabulary(b_path)
        pair, count, best = table.value
        for batch in batches:
            n_best, total = np.zeros((2, batch.num_rows), np.int64)
            for k, m, spans, edges in _spans_of(batch, tuple(x.lengths for x in models)):
                if not len(spans.at) or not len(pair):
                    continue
                found, nth = np.unique(spans.pairs(factor), return_inverse=True)
                place = np.minimum(np.searchsorted(pair, found), len(pair) - 1)
                there = pair[place] == found
                row = np.searchsorted(edges, spans.at)
                first = np.searchsorted(row, np.arange(m - k + 1))
                for out, of in ((n_best, best), (total, count)):
                    sums = np.append(0, np.cumsum(np.where(there, of[place], 0)[nth]))
                    out[k:m] += sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_best), pa.array(total)], [*batch.schema.names[:-2], "n_best", "count_sum"])

    return made.mapInArrow(run, PIECES.replace("ids_a binary, ids_b binary", "n_best long, count_sum long"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Space+text is tokenized by A and, as text, by B, which adds the space; byte
    offsets where tokens of both end cut them into groups; a link is a pair of
    tokens whose bytes overlap. ``n_best`` counts links whose id pair has its B
    id's highest count in the whole corpus, ties included, and ``count_sum``
    adds up the counts. ``pieces``, ``links`` and ``pair_counts`` give the
    groups and links themselves.

    A null or empty text, and one that either tokenizer doesn't give back byte
    by byte, has no tokens: zeros, and no hash. Very long texts are swept in
    windows. Repeated rows come back, and count, as often as they come; rows of
    one doc_id or none with different texts are documents of their own. An empty
    table gives no rows. Other columns are not read, whatever their names.

    The counts are taken to the tasks ``pairs`` at a time; with more pairs the
    pieces are read as often as needed.
    """
    a_path, b_path = a_path or vocabulary("byte_bpe_50k.json"), b_path or vocabulary("piece_bpe_32k.model")
    made, _ = written(pieces(docs, a_path, b_path))
    counts = materialize(pair_counts(made, a_path, b_path))
    parts = max(1, -(-counts.count() // pairs))
    found = reduce(DataFrame.unionByName, [_looked_up(made, counts, a_path, b_path, k, parts) for k in range(parts)])
    whole = found.groupBy("doc_id", "raw").agg(
        *[(F.sum(c) / parts).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"), F.max("times").alias("times"),
    )
    return whole.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("again", "raw", "times")
