"""Entries over pages, and corpora in parts whose digests are checked while they are read."""

import gzip
import hashlib
import json

import pytest

from sparkloom.sources.pages import grouped_entries, parse_pages, skipped
from sparkloom.sources.parts import ManifestParts, lines_of

PAGES = [
    ["afsky [abhor] (v.): ih, mudah", "huat tuam", "12", "", "bil [car]: mawtaw", "bilist [driver]"],
    ["(n.): mawtaw hawl", "goes on", "synonym", "[car]: mawtaw", "- [-]: nothing"],
    ["more of nothing", "hus [house] (N.): inn", "with [another] (v.): head"],
    ["mega [car]: mawtaw", "sidste [last]"],
]


def lines(spark, documents):
    rows = [(d, p, n, line) for d, pages in documents.items() for p, page in enumerate(pages, 1) for n, line in enumerate(page)]
    return spark.createDataFrame(rows, "document string, page int, line_no int, line string").repartition(3)


def test_entries_run_on_over_lines_and_pages(spark):
    got = [tuple(r)[1:] for r in parse_pages(lines(spark, {"d": PAGES})).orderBy("page", "position").collect()]
    assert got == [
        (1, 1, "afsky", "abhor", "v", "ih, mudah huat tuam"), (1, 2, "bil", "car", "", "mawtaw"), (1, 3, "bilist", "driver", "n", "mawtaw hawl goes on"),
        (2, 1, "synonym", "car", "", "mawtaw"), (2, 2, "-", "-", "", "nothing more of nothing"), (3, 1, "hus", "house", "n", "inn"),
        (3, 2, "with", "another", "v", "head"), (4, 1, "mega", "car", "", "mawtaw sidste [last]"),
    ]


def test_an_entry_over_three_pages_and_documents_apart(spark):
    documents = {"a": [["x [one]: begin"], ["middle"], ["end"]], "b": [["not an entry"], ["y [two]"]], "c": [["z [three]: own"]]}
    got = {r["document"]: (r["english"], r["gloss"]) for r in parse_pages(lines(spark, documents)).collect()}
    assert got == {"a": ("one", "begin middle end"), "c": ("three", "own")}


def test_equal_entries_are_one_record(spark):
    entries = parse_pages(lines(spark, {"d": PAGES[:3] + [["mega [Car]: mawtaw", "held [hero]: brave [more] (n.): joined"]]}))
    got = {r["record_id"]: r for r in grouped_entries(entries).collect()}
    assert [tuple(o) for o in got["p001-002"]["occurrences"]] == [(1, 2, "bil"), (2, 1, "synonym"), (4, 1, "mega")]
    assert {k for k, r in got.items() if r["issue"] == "merged_entry"} == {"p004-002"}
    assert {r["reason"]: r["n"] for r in skipped(entries).collect()} == {"no_english_headword": 1, "repeated_under_another_label": 2}


def parts(folder, bodies, damaged=None):
    listed = []
    for i, body in enumerate(bodies):
        name = f"part-{i}.csv.gz" if i % 2 == 0 else f"part-{i}.csv"
        data = gzip.compress(body[:20]) + gzip.compress(body[20:]) if i % 2 == 0 else body
        (folder / name).write_bytes(data)
        listed.append({"file": name, "sha256": hashlib.sha256(data if i != damaged else b"").hexdigest()})
    (folder / "manifest.json").write_text(json.dumps({"parts": listed}))
    return str(folder / "manifest.json")


BODIES = [b"id,text\r\n1,one\r\n2,two \xc3\xa9\r\n", b"id,text\n3,three\n4,four", b"id,text\r\n"]


def test_parts_in_manifest_order_with_one_header(spark, tmp_path):
    spark.dataSource.register(ManifestParts)
    got = spark.read.format("manifest_parts").load(parts(tmp_path, BODIES)).orderBy("part", "line_no").collect()
    assert [r["line"] for r in got] == ["id,text", "1,one", "2,two é", "3,three", "4,four"]
    assert [r["part"] for r in got] == [0, 0, 0, 1, 1]


def test_a_part_that_differs_is_refused(spark, tmp_path):
    spark.dataSource.register(ManifestParts)
    with pytest.raises(Exception, match="differs from its manifest"):
        spark.read.format("manifest_parts").load(parts(tmp_path, BODIES, damaged=1)).count()


def test_a_large_part_is_never_held(tmp_path):
    import tracemalloc

    line = b"0123456789" * 10 + b"\n"
    path = tmp_path / "large.csv.gz"
    with gzip.open(path, "wb", compresslevel=1) as out:
        for _ in range(64):
            out.write(line * 10_000)
    sha = hashlib.sha256(path.read_bytes()).hexdigest()
    tracemalloc.start()
    try:
        assert sum(1 for _ in lines_of(str(path), sha, header=False)) == 640_000
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
