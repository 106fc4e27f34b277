"""Sets of shingles as sorted hashes, many texts at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash

_DIGITS = regex.compile(r"\p{Nd}+")
# Byte tables: A-Z in lower case, ASCII white space.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(_LOWER, (9, 10, 11, 12, 13, 32))


def hashed_words(words: pa.Array, change=lambda w: w) -> np.ndarray:
    """A 64-bit hash of every word; each distinct word is looked at once."""
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(change(w)) for w in distinct), np.uint64, len(distinct))[coded.indices.to_numpy()]


def _runs(hashed: np.ndarray, per_text: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and how many each text has; shorter texts have ``least`` runs, of what words they have."""
    factors = np.random.default_rng(width).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.maximum(per_text - width + 1, least)
    ends = np.cumsum(per_text)
    first = np.repeat(ends - per_text - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    last = np.repeat(ends, counts)
    made = np.full(len(first), width, np.uint64)
    padded = np.append(hashed, np.uint64(0))
    for k, f in enumerate(factors):
        made += np.where(first + k < last, padded[np.minimum(first + k, len(hashed))] * f, np.uint64(0))
    made ^= made >> np.uint64(31)
    return made * np.uint64(0x9E3779B97F4A7C15), counts


def word_shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the distinct runs of ``width`` words, in A-Z lower-cased words between ASCII white space; a text of fewer words is one run."""
    data = np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8)
    solid = ~_SPACE[data]
    begins = np.flatnonzero(solid & np.append(True, ~solid[:-1])) if len(data) else np.zeros(0, np.int64)
    word = np.cumsum(solid)  # bytes of words up to a place
    stops = np.flatnonzero(~solid & np.append(False, solid[:-1])) if len(data) else begins
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(0, word[stops]).astype(np.int64)), pa.py_buffer(_LOWER[data][solid])]
    )
    per_text = np.diff(np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts])))
    made, counts = _runs(hashed_words(words), per_text, width, 1)
    edges = np.cumsum([0, *counts]).tolist()
    return [np.unique(made[a:b]) for a, b in zip(edges, edges[1:])]


def spelled_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of lower-case texts as ``text.spelling_tokens`` cuts them, its marks folded already, and how many each text has."""
    data = np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)
    letter = (data >= 97) & (data <= 122)
    after, before = np.append(False, letter)[: len(data)], np.append(letter, False)[1:]
    solid = letter | ((data == 39) & after) | ((data == 45) & after & before)
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    begins, stops = edges[::2], edges[1::2]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(0, np.cumsum(stops - begins))), pa.py_buffer(data[solid])])
    return words, np.diff(np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts])))


@cache
def _in_words() -> np.ndarray:
    """Of every code point whether it is a letter or a number."""
    found = np.zeros(0x110000, bool)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found[[ord(c) for c in regex.findall(r"[\p{L}\p{N}]", everything)]] = True
    return found


def loose_words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of letters and numbers, with apostrophes inside, A-Z in lower case, and how many each text has."""
    joined = b"".join([t + b"\n" for t in texts]).decode("utf-8", "replace")
    points, data = np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.frombuffer(joined.encode(), np.uint8)
    solid = np.append(_in_words()[points], False)
    inner = np.flatnonzero((points == 0x27) | (points == 0x2019))
    solid[inner[(solid[inner - 1] & solid[inner + 1])]] = True
    edges = np.flatnonzero(np.diff(solid, prepend=False))
    begins, stops = edges[::2], edges[1::2]
    size = 1 + (points > 0x7F).view(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    upto = np.append(0, np.cumsum(np.where(solid[:-1], size, 0)))  # bytes of words up to a place
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(0, upto[stops])), pa.py_buffer(_LOWER[data[np.repeat(solid[:-1], size)]])]
    )
    starts = np.append(0, np.cumsum(size))[begins]  # of words, in bytes
    lengths = np.array([len(t) + 1 if t.isascii() else len(t.decode("utf-8", "replace").encode()) + 1 for t in texts], np.int64)
    return words, np.diff(np.searchsorted(starts, np.cumsum(np.append(0, lengths))))


def loose_shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the distinct lower-case words, runs of digits as #, and pairs of neighbours."""
    words, per_text = loose_words(texts)
    hashed = hashed_words(words, lambda w: w if w.isalpha() else _DIGITS.sub("#", w.decode().lower()))
    pairs, counts = _runs(hashed, per_text, 2, 0)
    ends, stops = np.cumsum(per_text).tolist(), np.cumsum(counts).tolist()
    return [np.unique(np.concatenate([hashed[e - n : e], pairs[s - m : s]])) for e, n, s, m in zip(ends, per_text.tolist(), stops, counts.tolist())]
