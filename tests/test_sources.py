"""Readers and writers over small files made here."""

import gzip
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.numbering import numbered
from sparkloom.sources import files, sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pins(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    pin = hashlib.sha256(b"one").hexdigest()
    files.verify(spark, {str(tmp_path / "a.txt"): pin})
    with pytest.raises(files.SourceError):
        files.verify(spark, {str(tmp_path / "a.txt"): "0" * 64})


def test_pairs_of_several_formats(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write('en,target,note\n"say ""hi""",x,n\n"two\nlines",,\n')
    (tmp_path / "b.jsonl").write_text('{"en": "e", "target": "z", "id": 7}\n')
    got = files.read_pairs(spark, [str(tmp_path / "a.csv.gz"), str(tmp_path / "b.jsonl")])
    assert rows(got, "source_text", "target_text", "id") == [("e", "z", 7), ('say "hi"', "x", None), ("two\nlines", "", None)]
    (tmp_path / "c.csv").write_text("en,other\na,b\n")
    with pytest.raises(files.SourceError):
        files.read_pairs(spark, [str(tmp_path / "c.csv")])


def test_line_numbers_across_splits(spark, tmp_path):
    lines = [f"line {i}" for i in range(1, 3001)]
    (tmp_path / "long.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert got.select("line_no", "line").orderBy("line_no").collect() == [(i, f"line {i}") for i in range(1, 3001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_bytes(b'{"a": 1}\n\n[1]\n{"a": \n{"a": "\xff"}\n')
    assert rows(files.read_records(spark, str(tmp_path / "r.jsonl")), "line_no", F.coalesce("problem", F.lit(""))) == [
        (1, ""), (3, "not an object"), (4, "not JSON"), (5, "not UTF-8"),
    ]


def test_queue(spark, tmp_path):
    (tmp_path / "q").write_text('corpus-7\n{"id": "8", "english_sha256": "ab"}\n\n7\n')
    assert rows(files.read_queue(spark, str(tmp_path / "q")), "id", F.coalesce("english_sha256", F.lit("")), "line_no") == [("7", "", 1), ("8", "ab", 2)]


@pytest.mark.parametrize(
    ("text", "fine"), [("code,role\nA1,owner\nB2,Reviewer\n", True), ("code,role\nA1,owner\nB2,owner\n", False), ("code,role\nA1,owner\nA1,reviewer\n", False), ("code,role\nA1,boss\n", False)]
)
def test_roster(spark, tmp_path, text, fine):
    (tmp_path / "r.csv").write_text(text)
    if fine:
        assert rows(files.read_roster(spark, str(tmp_path / "r.csv")), "code", "role") == [("A1", "owner"), ("B2", "reviewer")]
    else:
        with pytest.raises(files.SourceError):
            files.read_roster(spark, str(tmp_path / "r.csv"))


def test_terms(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("sun\tni\tnorth\nmoon\tလ\t\nstar\taက\tx\nbad\tline\n")
    got = files.read_terms(spark, str(tmp_path / "t.tsv"))
    assert rows(got, "line_no", F.coalesce("script", F.lit("")), F.array_join("issues", ",")) == [
        (1, "latin", ""), (2, "my", "unlabelled variety"), (3, "my", "mixed script"), (4, "", "columns"),
    ]


def test_dictionary(spark, tmp_path):
    book = [{"headword": " sun ", "senses": [{"pos": "N.", "translations": ["ni", "nisa"], "examples": ["x"]}, {"pos": "v", "translations": ["po"]}]}, {"headword": "", "senses": []}]
    (tmp_path / "d.json").write_text(json.dumps(book, indent=1))
    assert rows(files.read_dictionary(spark, str(tmp_path / "d.json")), "headword", "sense_no", "pos", "translation", F.size("examples")) == [
        ("sun", 0, "n", "ni; nisa", 1), ("sun", 1, "v", "po", 0),
    ]


def test_ocr_lines(spark):
    df = spark.createDataFrame([("sun [sʌn] n. ni, nisa",), ("12 --- 13",), ("run v. Target: tai",)], "line string")
    got = files.parse_ocr_lines(df)
    assert rows(got, "headword", F.coalesce("phonetic", F.lit("")), "pos", "translation") == [("run", "", "v", "tai"), ("sun", "sʌn", "n", "ni, nisa")]


def test_usfm(spark, tmp_path):
    (tmp_path / "g.usfm").write_text("\\id GEN x\n\\c 1\n\\s Title\n\\p\n\\v 1 In the \\f + note\\f* start\n\\v 2-3 and \\nd then\\nd*\n\\c 2\n\\v 1 so\n")
    got = files.read_usfm(spark, str(tmp_path / "g.usfm"))
    assert rows(got, "book", "chapter", "verse", "text") == [("GEN", 1, "1", "In the start"), ("GEN", 1, "2-3", "and then"), ("GEN", 2, "1", "so")]
    assert rows(got, *files.span(F.col("verse"))) == [(1, 1), (1, 1), (2, 3)]


def test_usx(spark, tmp_path):
    (tmp_path / "g.usx").write_text(
        '<usx><book code="GEN">x</book><chapter number="1"/><para style="s1">Title</para><para style="p"><verse number="1"/>In the <note>no</note><char>start</char>'
        '<verse eid="e"/></para><para style="p"><verse number="2-3"/>and then</para></usx>'
    )
    assert rows(files.read_usx(spark, str(tmp_path / "g.usx")), "book", "chapter", "verse", "text") == [("GEN", 1, "1", "In the start"), ("GEN", 1, "2-3", "and then")]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Main"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>word</t></si><si><r><t>s</t></r><r><t>un</t></r></si></sst>")
        z.writestr(
            "xl/worksheets/sheet1.xml",
            f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row>'
            '<row r="3"><c r="B3" t="inlineStr"><is><t>x</t></is></c><c r="C3"><f>A1</f><v>1</v></c></row></sheetData></worksheet>',
        )
    book = files.read_workbook(spark, str(tmp_path / "b.xlsx"))
    assert rows(files.sheet_table(book, "Main", ["word", "pos", "tier", "more"], 2, "word"), "row_no", "word", "pos", "tier", "more") == [(2, "sun", "", "7", "")]
    assert rows(book.where("has_formula"), "row_no") == [(3,)]


def test_publish_is_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test"))
    about = sinks.publish(df, str(tmp_path / "release"), by="split")
    assert about["rows"] == 10 and about["bytes"] > 0
    assert json.loads(spark.read.text(str(tmp_path / "release/manifest")).first()[0]) == about
    assert spark.read.parquet(str(tmp_path / "release/data")).where("split = 'test'").count() == 2
    with pytest.raises(sinks.PublishError):
        sinks.publish(df, str(tmp_path / "release"))
    assert [p.name for p in tmp_path.iterdir()] == ["release"]


def test_routed_json_and_manifest(spark, tmp_path):
    sinks.write_routed(spark.createDataFrame([(1, "kept", None), (2, "review", "x")], "id int, route string, note string"), str(tmp_path / "out"), "route")
    assert spark.read.json(str(tmp_path / "out/route=kept")).columns == ["id", "note"]
    files_ = sinks.manifest(spark, str(tmp_path / "out")).collect()
    assert len(files_) == 2 and all(len(r["sha256"]) == 64 for r in files_)


def test_rejects(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "n int")
    good, bad, counts = sinks.split_valid(df, F.array_compact(F.array(F.when(F.col("n") > 1, "big"), F.when(F.col("n") > 2, "huge"))))
    assert rows(good, "n") == [(1,)] and rows(bad, "n") == [(2,), (3,)] and rows(counts, "problem", "records") == [("big", 2), ("huge", 1)]


def test_blind_sheet(spark):
    df = spark.createDataFrame([("b", "=1+1", "m1"), ("a", "fine", "m2")], "place string, text string, model string")
    sheet, key = sinks.review_sheets(df, "place", ["text"], ["model"])
    assert rows(sheet, "sample_id", "text") == [("R00001", "fine"), ("R00002", "'=1+1")]
    assert rows(key, "sample_id", "model") == [("R00001", "m2"), ("R00002", "m1")]


def test_numbered_within_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("g")).alias("g"), F.lit("x").alias("more"))
    got = numbered(df, "id", "nth", within="g").toPandas()
    for _, part in got.groupby(got["g"].fillna("-")):
        assert part.sort_values("id")["nth"].tolist() == list(range(1, len(part) + 1))
