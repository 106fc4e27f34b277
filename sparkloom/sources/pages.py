"""Dictionary entries of paged text, where labels and translations run on over lines and pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# An entry is "label [english] (pos): translation"; a label may wrap right behind its english.
_ENTRY = re.compile(r"^([^\[]*?)\s*\[([^\]]*)\](?:\s*\(([^)]*)\))?:\s*(.*)$")
_HEAD = re.compile(r"^[^\[]*\[[^\]]*\]$")

#: page and position tell where an entry begins; position counts the entries of a page from 1.
_ENTRIES = "document string, page int, position int, label string, english string, pos string, gloss string"


@dataclass
class _Parser:
    """Reads the lines of one document after the other; keeps the open entry and a label that waits for its next line."""

    document: str | None = None
    open: list | None = None
    lines: list[str] = field(default_factory=list)
    waiting: tuple[str, int] | None = None
    page: int | None = None
    position: int = 0
    done: list[tuple] = field(default_factory=list)

    def close(self) -> None:
        if self.waiting and self.open:
            self.lines.append(self.waiting[0])
        self.waiting = None
        if self.open:
            self.done.append((*self.open, " ".join(" ".join(self.lines).split())))
        self.open, self.lines = None, []

    def add(self, document: str | None, page: int, line: str | None) -> None:
        if document != self.document:
            self.close()
            self.document, self.page, self.position = document, None, 0
        line = (line or "").strip()
        if not line or line.isdigit():
            return
        if _HEAD.match(line):
            if self.waiting and self.open:
                self.lines.append(self.waiting[0])
            self.waiting = line, page
            return
        if self.waiting:
            line, page = f"{self.waiting[0]} {line}", self.waiting[1]
            self.waiting = None
        if found := _ENTRY.match(line):
            label, english, pos, rest = found.groups()
            if not label.strip() and self.open and len(self.lines) > 1:
                label = self.lines.pop()  # it was read as the last line of the entry before
            self.close()
            self.position = self.position + 1 if page == self.page else 1
            self.page = page
            flat = lambda x: " ".join((x or "").split())
            self.open, self.lines = [document, page, self.position, flat(label), flat(english), flat(pos).rstrip(".").lower()], [rest]
        elif self.open:
            self.lines.append(line)


def parse_pages(lines: DataFrame) -> DataFrame:
    """document, page, position, label, english, pos, gloss of every entry; ``lines``: document, page, line_no, line.

    A line that is no entry goes on with the gloss of the last one; a label
    that ends at its english waits for the next line, on the next page too; an
    entry without a label takes the line before. Blank lines and page numbers
    are left out. Documents are dealt out and sorted; of each only the open
    entry is kept, so neither a corpus nor a document has to fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser()
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4]
        names = [c.split()[0] for c in _ENTRIES.split(", ")]

        def given() -> pa.RecordBatch:
            rows, parser.done = parser.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for document, page, line in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                parser.add(document, page, line)
            if parser.done:
                yield given()
        parser.close()
        if parser.done:
            yield given()

    order = ("document", "page", "line_no")
    rows = lines.select(F.col("document").cast("string"), F.col("page").cast("int"), F.col("line_no").cast("long"), "line")
    return rows.repartition("document").sortWithinPartitions(*order).mapInArrow(run, _ENTRIES)


def grouped_entries(entries: DataFrame) -> DataFrame:
    """Entries with an english word, those equal in english, pos and gloss as one, with record_id, issue, labels and pages of all.

    The first by document, page and position names the record. A gloss that
    holds another entry's head is flagged ``merged_entry``.
    """
    key = ["document", F.lower("english").alias("key"), "pos", "gloss"]
    kept = entries.where(F.regexp_replace("english", "-", "") != "")
    at = F.struct("page", "position", "english")
    grouped = kept.groupBy(*key).agg(F.min(at).alias("first"), F.array_sort(F.collect_list(F.struct("page", "position", "label"))).alias("occurrences"))
    record = F.format_string("p%03d-%03d", "first.page", "first.position")
    issue = F.when(F.col("gloss").rlike(r"\[[^\]]+\]\s*(\([^)]*\))?:"), "merged_entry")
    return grouped.select("document", record.alias("record_id"), F.col("first.english").alias("english"), "pos", "gloss", issue.alias("issue"), "occurrences")


def skipped(entries: DataFrame) -> DataFrame:
    """reason and n: entries without an english word, and those that repeat another under a different label."""
    nth = F.row_number().over(Window.partitionBy("document", F.lower("english"), "pos", "gloss").orderBy("page", "position"))
    reason = F.when(F.regexp_replace("english", "-", "") == "", "no_english_headword").when(nth > 1, "repeated_under_another_label")
    return entries.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
