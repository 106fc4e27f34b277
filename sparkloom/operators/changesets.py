"""Changes to dictionary rows that are matched by content, never by id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for their white space; null is empty."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x0B\p{Z}]+", " "))
    return flat(a) == flat(b)


class _Headword:
    """The rows of one headword, while its changes come by.

    Rows are found by what their text and definition say, so a change looks at
    those that it matches, not at all. Rows with the same notes are one group:
    a note goes to groups.
    """

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.by_text: dict[tuple[str, ...], set[int]] = {}
        self.by_definition: dict[str, set[int]] = {}
        self.notes: dict[str | None, int] = {}  # notes and the number of their group
        self.groups: list[list[int]] = []  # the rows of each group
        self.added: set[str] = set()

    def add(self, row_id: int | None, text: str | None, definition: str | None, notes: str | None) -> None:
        k = len(self.rows)
        self.rows.append([row_id, text, definition])
        self.by_text.setdefault(_parts(text), set()).add(k)
        self.by_definition.setdefault(_flat(definition), set()).add(k)
        group = self.notes.setdefault(notes, len(self.groups))
        if group == len(self.groups):
            self.groups.append([])
        self.groups[group].append(k)
        self.added.clear()

    def all_rows(self) -> Iterator[tuple]:
        for notes, group in self.notes.items():
            for k in self.groups[group]:
                yield *self.rows[k], notes

    def apply(self, op: str, before: str | None, after: str | None) -> str:
        if op == "add_note":
            return self._note(after)
        index, key, made = (self.by_text, _parts, 1) if op == "set_text" else (self.by_definition, _flat, 2)
        asked = key(before)
        found = index.get(asked, ()) if asked or op != "set_text" else ()
        if len(found) != 1:
            return "ambiguous" if found else "no_match"
        (k,) = index.pop(asked)
        self.rows[k][made] = " ; ".join(_parts(after)) if op == "set_text" else after
        index.setdefault(key(after), set()).add(k)
        return "applied"

    def _note(self, after: str | None) -> str:
        # Notes only grow: once added, a note is in all of them.
        if not after or after in self.added:
            return "no_match"
        self.added.add(after)
        touched = [n for n in self.notes if after not in (n or "")]
        for notes in touched:
            group = self.notes.pop(notes)
            new = f"{notes}; {after}" if notes else after
            there = self.notes.setdefault(new, group)
            if there != group:  # others have these notes already: the smaller group joins the larger one
                few, many = sorted((group, there), key=lambda g: len(self.groups[g]))
                self.groups[many] += self.groups[few]
                self.groups[few] = []
                self.notes[new] = many
        return "applied" if touched else "no_match"


def _flat(text: str | None) -> str:
    return " ".join((text or "").split())


def _parts(text: str | None) -> tuple[str, ...]:
    return tuple(x for x in map(_flat, (text or "").split(";")) if x)


_MADE = "id long, headword string, text string, definition string, notes string, position long, outcome string"


def _played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a headword, then its changes in order; gives each change's outcome as it comes and the rows when they end."""
    head, there = None, _Headword()
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in _MADE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        out: list[tuple] = []
        for headword, position, op, row_id, text, definition, notes in zip(*(c.to_pylist() for c in batch.columns)):
            if headword != head:
                out += [(r[0], head, *r[1:], None, None) for r in there.all_rows()]
                head, there = headword, _Headword()
            if op is None:
                there.add(row_id, text, definition, notes)
            else:
                # Of a change, text and definition are what it expects and what it makes.
                outcome = there.apply(op, text, definition) if there.rows else "unknown_headword"
                out.append((None, None, None, None, None, position, outcome))
        if out:
            yield batch_of(out)
    if there.rows:
        yield batch_of([(r[0], head, *r[1:], None, None) for r in there.all_rows()])


def apply_matched(live: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows after all changes, and position and outcome of every change.

    ``live`` has id, headword, text, definition, notes; ``changes`` position,
    op, headword, before, after. A change is made only where it finds what it
    expects, at its turn:

    ``set_text``        the one row of its headword whose alternatives are those of ``before`` gets those of ``after``
    ``set_definition``  the one row whose definition is ``before`` but for white space gets ``after``
    ``add_note``        every row of the headword without the note gets it

    Outcomes: applied, unknown_headword, no_match, ambiguous (more rows than one
    match, none is changed), not_shown (any other op). Changes of one headword
    come one after another by position, so one may build on the one before.
    Rows and changes are dealt out by headword and sorted; a task holds the rows
    of one headword, its changes pass by. Positions are unique.
    """
    shown = F.col("op").isin("set_text", "set_definition", "add_note")
    none = F.lit(None)
    rows = live.select("headword", none.cast("long").alias("position"), none.cast("string").alias("op"), "id", "text", "definition", "notes")
    asked = changes.where(shown).select("headword", "position", "op", none.cast("long").alias("id"), F.col("before").alias("text"), F.col("after").alias("definition"), none.cast("string").alias("notes"))
    dealt = rows.unionByName(asked).repartition("headword").sortWithinPartitions("headword", F.col("position").asc_nulls_first(), "id")
    played = checkpointed(dealt.mapInArrow(_played, _MADE))
    outcomes = played.where("outcome IS NOT NULL").select("position", "outcome")
    others = changes.where(~F.coalesce(shown, F.lit(False))).select("position", F.lit("not_shown").alias("outcome"))
    return played.where("outcome IS NULL").drop("position", "outcome"), outcomes.unionByName(others)
