"""Readers for the file formats that corpora, dictionaries, verses and review logs come in.

Everything is read by Spark, so paths may lie in any store it knows. Formats
that Spark reads itself (CSV, JSON lines, gzip, text) stay with its readers;
the two that are one document a file (XML books, workbooks) are parsed in
Arrow batches, a file being the unit of work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A source isn't what its registry, schema or manifest says."""


def verify(spark: SparkSession, pins: dict[str, str]) -> None:
    """Stop unless every file has its pinned SHA-256; files are hashed where they are read."""
    if not pins:
        return
    plain = lambda p: re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", p)
    found = spark.read.format("binaryFile").load(list(pins)).select("path", F.sha2("content", 256).alias("sha")).collect()
    shas = {plain(r["path"]): r["sha"] for r in found}
    wrong = sorted(p for p, sha in pins.items() if shas.get(plain(p)) != sha.lower())
    if wrong:
        raise SourceError(f"checksum differs: {', '.join(wrong)}")


def read_pairs(spark: SparkSession, paths: list[str], source: str = "en", target: str = "target") -> DataFrame:
    """Sentence pairs of .jsonl, .csv or .csv.gz files: source_text, target_text (null is empty) and all further columns.

    Each part of a CSV corpus has its own header; the two named columns must be there.
    """
    json_like = [p for p in paths if re.search(r"\.jsonl?(\.gz)?$", p)]
    tables = [spark.read.json(p) for p in json_like]
    tables += [
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in paths if p not in json_like
    ]
    out = None
    for t in tables:
        if missing := {source, target} - set(t.columns):
            raise SourceError(f"missing columns: {', '.join(sorted(missing))}")
        rest = [c for c in t.columns if c not in (source, target, "source_text", "target_text")]
        named = t.select(F.coalesce(source, F.lit("")).alias("source_text"), F.coalesce(target, F.lit("")).alias("target_text"), *rest)
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line of text files, blank lines too.

    A split of a file knows its offset, so lines are numbered per split and
    moved on by the counts of the splits before: no file goes through one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.select(
        "file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before")
    )
    nth = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return raw.withColumn("nth", nth).join(before, ["file", "block"]).select(
        "file", (F.col("before") + F.col("nth")).alias("line_no"), "line"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Strict JSON lines: file, line_no, line and ``problem``, null for a sound record. Blank lines are skipped."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = F.try_parse_json("line")
    problem = (
        F.when(~F.is_valid_utf8("line"), "not UTF-8")
        .when(parsed.isNull(), "not JSON")
        .when(~F.schema_of_variant(parsed).startswith("OBJECT"), "not an object")
    )
    return rows.withColumn("problem", problem)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """id, english_sha256 (null for a bare id) of a review queue, the first line of each id; the prefix corpus- goes."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    whole = F.trim("line")
    is_json = whole.startswith("{")
    named = rows.select(
        "line_no",
        F.regexp_replace(F.when(is_json, F.get_json_object(whole, "$.id")).otherwise(whole), "^corpus-", "").alias("id"),
        F.when(is_json, F.get_json_object(whole, "$.english_sha256")).alias("english_sha256"),
    )
    return named.groupBy("id").agg(F.min(F.struct("line_no", "english_sha256")).alias("first")).select("id", "first.english_sha256", "first.line_no")


ROLES = ("reviewer", "approver", "owner")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """code, role of a roster; unknown roles, repeated codes and a second owner are refused. A roster has one row a person."""
    rows = spark.read.option("header", True).csv(path).select(F.trim("code").alias("code"), F.lower(F.trim("role")).alias("role"))
    bad = rows.agg(
        F.count_if(F.coalesce(~F.col("code").rlike("^[A-Za-z0-9_-]+$"), F.lit(True))).alias("malformed code"),
        F.count_if(F.coalesce(~F.col("role").isin(*ROLES), F.lit(True))).alias("unknown role"),
        (F.count("code") - F.countDistinct("code")).alias("repeated code"),
        F.greatest(F.count_if(F.col("role") == "owner") - 1, F.lit(0)).alias("second owner"),
    ).first()
    if wrong := [k for k, n in bad.asDict().items() if n]:
        raise SourceError(f"roster: {', '.join(wrong)}")
    return rows


_MYANMAR = r"[\x{1000}-\x{109F}]"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Three-column TSV terms: line_no, english, form, variety, script and issues.

    Lines without exactly three columns have the issue alone. A form in the
    Myanmar block is Burmese, one that mixes scripts an issue, as is a form
    without a named variety.
    """
    cut = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("c", F.split("line", "\t", -1))
    get = lambda i: F.trim(F.get("c", F.lit(i)))
    form = get(1)
    burmese, latin = form.rlike(_MYANMAR), form.rlike("[A-Za-z]")
    fits = F.size("c") == 3
    issues = F.array_compact(
        F.array(
            F.when(~fits, "columns"), F.when(fits & burmese & latin, "mixed script"), F.when(fits & (get(2) == ""), "unlabelled variety")
        )
    )
    when = lambda c: F.when(fits, c)
    return cut.select(
        "line_no", when(get(0)).alias("english"), when(form).alias("form"), when(get(2)).alias("variety"),
        when(F.when(burmese, "my").otherwise("latin")).alias("script"), issues.alias("issues"),
    )


_SENSES = "array<struct<headword:string,pos:string,translations:array<string>,examples:array<string>>>"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON dictionaries (one array of entries a file) to one record a sense.

    entry_no, sense_no, headword, pos, translation, examples; entries without a headword are dropped.
    """
    entry = "struct<headword:string,senses:array<struct<pos:string,translations:array<string>,examples:array<string>>>>"
    books = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<{entry}>").alias("entries"))
    entries = books.select(F.posexplode("entries").alias("entry_no", "e")).where(F.trim("e.headword") != "")
    senses = entries.select("entry_no", F.trim("e.headword").alias("headword"), F.posexplode("e.senses").alias("sense_no", "s"))
    return senses.select(
        "entry_no", "sense_no", "headword", F.lower(F.trim(F.regexp_replace("s.pos", r"\.", ""))).alias("pos"),
        F.array_join("s.translations", "; ").alias("translation"), F.coalesce("s.examples", F.array().cast("array<string>")).alias("examples"),
    )


# OCR lines: headword, [phonetic], part of speech, then the translation after the first separator that is there.
_OCR = r"^([A-Za-z][A-Za-z' -]*?)\s*(?:\[([^\]]*)\])?\s*\(?\b(n|v|adj|adv|prep|conj|pron|int)\b\.?\)?\s*(?:\t|{label}:|[-–—]|\s{2,}|\s)\s*(.+)$"


def parse_ocr_lines(rows: DataFrame, line: str = "line", label: str = "Target") -> DataFrame:
    """The rows with headword, phonetic (null if there is none), pos and translation; noise lines go.

    ``label`` is the word that may announce a translation.
    """
    pattern = _OCR.replace("{label}", re.escape(label))
    part = lambda i: F.trim(F.regexp_extract(line, pattern, i))
    return rows.where(F.col(line).rlike(pattern)).withColumns(
        {"headword": part(1), "phonetic": F.nullif(part(2), F.lit("")), "pos": part(3), "translation": part(4)}
    )


def span(label: Column) -> tuple[Column, Column]:
    """First and last verse of a label such as 17 or 17-18."""
    ends = F.split(label, "[-–]")
    return F.get(ends, F.lit(0)).cast("int"), F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))).cast("int")


def read_usfm(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, verse (a label, maybe a range), text of USFM books: one file is one book.

    Notes and cross references are dropped, other markers removed and their text kept.
    """
    book = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?s)\\(f|x)\s.*?\\\1\*", "").alias("t"))
    head = book.select(F.regexp_extract("t", r"\\id\s+(\S+)", 1).alias("book"), F.posexplode(F.split("t", r"\\c\s+", -1)).alias("n", "c")).where("n > 0")
    chapters = head.select("book", F.regexp_extract("c", r"^(\d+)", 1).cast("int").alias("chapter"), F.posexplode(F.split("c", r"\\v\s+", -1)).alias("n", "v")).where("n > 0")
    text = F.regexp_replace(F.regexp_replace("v", r"^\S+\s*", ""), r"(?m)\\s\d?\s.*$|\\[a-z]+\d*\*?", " ")
    return chapters.select(
        "book", "chapter", F.regexp_extract("v", r"^(\S+)", 1).alias("verse"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text")
    )


_SKIPPED = ("note", "figure", "sidebar")
_HEADINGS = re.compile(r"(?:mt|ms|s|r|d|h|toc|id)\d*$")


def usx_verses(content: bytes) -> list[tuple[str, int, str, str]]:
    """(book, chapter, verse, text) of one USX book; text in document order, without headings and notes."""
    root = ElementTree.fromstring(content)
    book, chapter, verse = "", 0, ""
    texts: dict[tuple[int, str], list[str]] = {}

    def walk(node: ElementTree.Element) -> None:
        nonlocal book, chapter, verse
        if node.tag == "book":
            book = node.get("code", "")
            return
        if node.tag == "chapter":
            chapter, verse = int(node.get("number") or chapter), ""
        elif node.tag == "verse":
            verse = "" if node.get("eid") else node.get("number", "")
        elif node.tag not in _SKIPPED and not (node.tag == "para" and _HEADINGS.match(node.get("style", ""))):
            keep(node.text)
            for child in node:
                walk(child)
                keep(child.tail)

    def keep(text: str | None) -> None:
        if text and verse:
            texts.setdefault((chapter, verse), []).append(text)

    walk(root)
    return [(book, c, v, " ".join(" ".join(parts).split())) for (c, v), parts in texts.items()]


def read_usx(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, verse (a label), text of USX books, a book a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([v for c in pdf["content"] for v in usx_verses(c)], columns=["book", "chapter", "verse", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "book string, chapter int, verse string, text string")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str], bool]]:
    """(sheet, row_no, cells, has_formula) of a workbook; cells as text, gaps empty."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        for k, name in enumerate(names, 1):
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    column = 0
                    for letter in re.match("[A-Z]+", c.get("r", "A"))[0]:
                        column = column * 26 + ord(letter) - 64
                    value = c.find(f"{_MAIN}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if value is None else value.text or ""
                    cells += [""] * (column - len(cells))
                    cells[column - 1] = shared[int(text)] if c.get("t") == "s" else text
                out.append((name, int(row.get("r", 0)), cells, row.find(f"{_MAIN}c/{_MAIN}f") is not None))
    return out


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row_no (from 1), cells (array of text), has_formula of workbooks: filters and columns are then plain DataFrame code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for c in pdf["content"] for r in sheet_rows(c)], columns=["sheet", "row_no", "cells", "has_formula"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        run, "sheet string, row_no int, cells array<string>, has_formula boolean"
    )


def sheet_table(book: DataFrame, sheet: str, columns: list[str], first_row: int, required: str) -> DataFrame:
    """A sheet's rows from ``first_row`` as named columns, short rows padded with empty text; rows without the required column go."""
    rows = book.where((F.col("sheet") == sheet) & (F.col("row_no") >= first_row))
    named = rows.select("row_no", "has_formula", *[F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(c) for i, c in enumerate(columns)])
    return named.where(F.col(required) != "")
