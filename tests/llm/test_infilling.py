"""Fill-in-the-middle against the unit pattern itself, and exact round trips."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import infilling

from .conftest import HARD

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["<P", "a<P>b", "x<S>", "<M>", "<P<S", "<<", "é", "aé b", "été à l'aube", "a1b2", " a", "a ", "漢字kana仮名", "\n\na\n", "?a?", "🙂x🙂", "Ｆull", "ſt", "a\x00b", "K", "İi"]


def brute(doc_id, text):
    """n, form, prefix_chars, middle_chars, output by the contract's words."""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{doc_id if doc_id is not None else ''}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10_000), st.text(st.sampled_from("abZ 1é漢<>PSM\n🙂"), max_size=40) | st.text(max_size=30).filter(lambda t: not re.search("[\ud800-\udfff]", t)))
def test_against_the_pattern(doc_id, text):
    assert infilling.transformed(doc_id, text) == brute(doc_id, text)


def test_every_rank():
    for text in [*ODD, *[t or "" for _, t in HARD]]:
        units = infilling.Units(text)
        found = UNIT.findall(text)
        assert len(units) == len(found)
        for rank in {*range(min(30, len(found) + 1)), len(found) // 2, len(found)}:
            assert units.end(rank) == sum(map(len, found[:rank]))


def test_round_trip_and_hard_rows(spark, hard, nothing):
    rows = [(i, t) for i, t in enumerate(ODD * 20)]
    made = infilling.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).select("*", infilling.restored("output", "form").alias("back"))
    got = made.collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], rows[r["doc_id"]][1])
        assert r["back"] == rows[r["doc_id"]][1]
    digests = infilling.digest(infilling.fill_in_middle(hard)).collect()
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in HARD)
    assert sorted(r["restored_sha256"] for r in digests) == want
    assert infilling.digest(infilling.fill_in_middle(nothing)).count() == 0
