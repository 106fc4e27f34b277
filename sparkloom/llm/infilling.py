"""Fill-in-the-middle transformation by sparse events of one automaton (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages: documents that are transformed, and of these the ones with their suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of texts whose results are handed on at once.
TOGETHER = 8 << 20

_ENTER, _LEAVE, _SENTINEL = range(3)


@cache
def _automaton() -> ahocorasick.Automaton:
    """Finds every ASCII character whose class, letter or not, isn't that of the one before, and every sentinel."""
    letters = [chr(c) for c in range(128) if chr(c).isalpha()]
    others = [chr(c) for c in range(128) if not chr(c).isalpha()]
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for x, y in product(others, letters):
        found.add_word(x + y, _ENTER)
        found.add_word(y + x, _LEAVE)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(sentinel, _SENTINEL)
    found.make_automaton()
    return found


class Units:
    """Units of a text, runs of A-Z and a-z or single other characters, by the events where runs change.

    Every other character counts as one ASCII character that is no letter, so
    positions are code points, and between two events a run of letters is one
    unit and a run of others has as many as its length.
    """

    def __init__(self, text: str):
        plain = text.encode("ascii", "replace").decode("ascii")
        events = np.fromiter(chain.from_iterable(_automaton().iter(plain)), np.int64).reshape(-1, 2)
        self.sentinel = bool((events[:, 1] == _SENTINEL).any())
        changes = events[events[:, 1] != _SENTINEL]
        self.ends = np.append(changes[:, 0], len(plain)) if plain else np.zeros(0, np.int64)
        self.letters = np.append(changes[:, 1] == _LEAVE, plain[-1:].isalpha()) if plain else np.zeros(0, bool)
        self.ranks = np.cumsum(np.where(self.letters, 1, np.diff(self.ends, prepend=0)))

    def __len__(self) -> int:
        return int(self.ranks[-1]) if len(self.ranks) else 0

    def end(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        if not rank:
            return 0
        k = int(np.searchsorted(self.ranks, rank))
        return int(self.ends[k]) if self.letters[k] else int(self.ends[k] - (self.ranks[k] - rank))


def transformed(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the new text."""
    units = Units(text)
    n = len(units)
    digits = hashlib.sha256(b"1:" if doc_id is None else b"1:%d" % doc_id).hexdigest()
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or units.sentinel or h3 % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    a, b = (units.end(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document.

    A text of n units is cut at two ranks drawn from the hash of its doc_id,
    and its parts are put in the order prefix, suffix, middle (psm) or suffix,
    prefix, middle (spm), each after its sentinel. A plain document keeps its
    text: an empty one, one that holds a sentinel, and a tenth of the others.

    Null text counts as empty, a null doc_id as no digits. Equal ranks give an
    empty middle. Very long texts take memory for their events, one for each
    change between letters and others. Repeated rows come back as often as they
    come, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch)
            ids = batch.column(0).to_pylist()
            k = 0
            while k < len(ids):
                m = max(k + 1, int(np.searchsorted(at, at[k] + TOGETHER, "right")) - 1)
                rows = [transformed(ids[i], data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(k, m)]
                n, form, prefix, middle, output = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, m - k), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )
                k = m

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of the given form was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The columns of ``fill_in_middle`` with hashes of the output and of the text restored from it in its place."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )
