"""The alignment sweep against token-by-token brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import alignment
from sparkloom.llm.packing import vocabulary

from .conftest import HARD

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    "Hello world, it's nine o'clock.", "<|endoftext|> is text, <s> and </s> too", "a▁b", " leading", "trailing ", "  two  spaces  ", " ", "   ", "\n\nline\n \n x", "tab\tand nbsp  em",
    "é à l'été über Straße", "漢字 仮名 🙂🙂 ﬁ ①", "é combining", "x" * 300, "  a", "ÿ ɏ ʯ ˀ b", "don't  we'll 'em", "1 234,567.89 a1b2", "\x00 \x1f \x7f a", "Ġ Ċ", "ﷺ <unk>",
]


@pytest.fixture(scope="module")
def whole():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return lambda t: (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t))


def brute(rows, whole):
    """Per row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    tokens = [alignment._vocabulary(p).tokens for p in (A, B)]
    made, counts = [], Counter()
    for doc_id, text in rows:
        sides = whole(text) if text else ([], [])
        if not text or any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in zip(tokens, sides)):
            made.append((doc_id, 0, 0, [], []))
            continue
        spans = []
        for t, ids in zip(tokens, sides):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(t[i]), i))
                at += len(t[i])
            spans.append(own)
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for s, e, i in own if begin <= s and e <= end) for own in spans))
            begin = end
        links, j = [], 0
        for s, e, i in spans[0]:
            links += [(i, k) for x, y, k in spans[1] if x < e and y > s]
        counts.update(links)
        made.append((doc_id, len(sides[0]), len(sides[1]), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for doc_id, n_a, n_b, groups, links in made:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def same(spark, rows, whole, **changed):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(df, **changed)) == sorted(brute(rows, whole), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1.,'é漢\n\t▁🙂 "), min_size=1, max_size=30), min_size=1, max_size=8))
def test_units_give_the_ids_of_the_whole(whole, texts):
    for path, side in ((A, 0), (B, 1)):
        model = alignment._vocabulary(path)
        for text, got in zip(texts, model.of([(" " + t).encode() for t in texts])):
            ids = whole(text)[side]
            fits = b"".join(model.tokens[i] for i in ids) == (" " + text).encode()
            assert (got is None) == (not fits), text
            assert got is None or got.tolist() == ids, text


def test_against_brute_force(spark, sf_dir, whole):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "same"), (5, "same"), (5, "other"), (None, "same"), (None, "same"), (None, None), (None, None)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(25).collect()
    rows += [(r[0], r[1][:3000]) for r in docs]
    same(spark, rows, whole)


def test_plan_choices_change_nothing(spark, whole, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, "über die Straße don't " * 40, "ab" * 500]) if t]
    want = sorted(brute(rows, whole), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert rows_of(alignment.align(df, pairs=7)) == want


    monkeypatch.setattr(alignment, "WINDOW", 16)
    # The constants are read in the workers: there the sweep itself is fed with the same narrow windows.
    models = alignment._vocabulary(A), alignment._vocabulary(B)
    import pyarrow as pa
    import zstandard

    sweep = alignment.Sweep(tuple(m.lengths for m in models), pa.array(alignment._names(models[0], "|") + alignment._names(models[1], ";"), pa.large_string()))
    pack, unpack = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    out = []
    for doc_id, text in rows:
        sides = [m.of([(" " + text).encode()])[0] for m in models]
        if any(x is None for x in sides):
            continue
        cut = [(m.lengths[x].cumsum() - 1) // 16 for m, x in zip(models, sides)]
        for w in range(int(max(c[-1] for c in cut)) + 1):
            for side, (x, c) in enumerate(zip(sides, cut)):
                assert sweep.add(doc_id, 0, len(text.encode()) + 1, w, side, True, pack(x[c == w].astype("<u2").tobytes()), unpack) is None
            out += sweep.flush()
    assert sweep.tokens == 0 and not sweep.open
    totals = defaultdict(lambda: [0, 0, 0, 0, ""])
    for r in out:
        totals[r[0]] = [*(x + y for x, y in zip(totals[r[0]], r[4:8])), r[8] or totals[r[0]][4]]
    assert {k: tuple(v) for k, v in totals.items()} == {w[0]: (*w[1:5], w[7]) for w in want if w[1]}


def test_links_and_counts(spark, whole):
    rows = [(1, "Straße über"), (2, "über über")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = alignment.pieces(df, A, B)
    got = alignment.links(made, A, B).collect()
    assert Counter(r["doc_id"] for r in got) == {w[0]: w[4] for w in brute(rows, whole)}
    assert all(r["start"] < r["end"] for r in got)
    counts = {(r["a_id"], r["b_id"]): r["count"] for r in alignment.pair_counts(made, A, B).collect()}
    assert counts == Counter((r["a_id"], r["b_id"]) for r in got)


def test_long_text_and_hard_rows(spark, hard, nothing, whole):
    rows = [(1, "the quick brown fox's über " * 12_000), (2, "漢字🙂" * 9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.align(df).collect()}
    for doc_id, text in rows:
        a, b = whole(text)
        assert (got[doc_id]["n_a"], got[doc_id]["n_b"]) == (len(a), len(b)) and got[doc_id]["n_groups"] > 0
    short = {repr((w[0], w[7])): w[1:5] for w in brute([h for h in HARD if len(h[1] or "") < 10_000], whole)}
    found = alignment.align(hard).collect()
    assert len(found) == len(HARD)
    seen = {repr((r["doc_id"], r["groups_sha256"])): (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in found}
    assert short.items() <= seen.items()
    assert alignment.align(nothing).count() == 0
