"""Exact and SimHash dedup against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import chunk_dedup, common, simhash
from sparkloom.llm.common import components

from .conftest import HARD, SCHEMA, rows_of

LOWER = {c: c + 32 for c in range(65, 91)}


def norm(t):
    return (t or "").translate(LOWER)


def test_exact_against_brute_force(hard):
    got = chunk_dedup.exact_dedup(hard).collect()
    assert len(got) == len(HARD)
    groups = defaultdict(list)
    for i, t in HARD:
        groups[norm(t)].append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): ids for k, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == best
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_empty(nothing):
    assert chunk_dedup.exact_dedup(nothing).count() == 0
    assert chunk_dedup.drop_duplicates(nothing).columns == nothing.columns


def test_drop_duplicates_keeps_columns_and_one_of_each(hard):
    got = chunk_dedup.drop_duplicates(hard)
    assert got.columns == hard.columns
    texts = [norm(r["text"]) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t in HARD})


def test_chunks_follow_content_and_respect_the_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(97, 123, 200_000).astype(np.uint8)
    ends = chunk_dedup.chunk_ends(a)
    assert ends[-1] == len(a) and 40 < len(ends) < 300
    shifted = np.concatenate([a[:7], np.frombuffer(b"inserted", np.uint8), a[7:]])
    same = {e + 8 for e in ends} & set(chunk_dedup.chunk_ends(shifted))
    assert len(same) > 0.95 * len(ends)
    assert np.diff([0, *chunk_dedup.chunk_ends(np.full(300_000, 120, np.uint8))]).max() <= chunk_dedup.MAX_CHUNK
    assert chunk_dedup.chunk_ends(np.zeros(0, np.uint8)) == [0]


def test_clashing_hashes_stay_apart(spark, monkeypatch):
    """With a chunk hash of one value every chunk clashes; identifiers must still tell texts apart."""
    rows = [(1, "aa", 1), (2, "bb", 2), (3, "aa", 1)]
    real = chunk_dedup._recipes

    def clashing(batches):
        for b in real(batches):
            d = b.to_pydict()
            for chunks in d["chunks"]:
                for c in chunks:
                    c["h"] = 0
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict(d, schema=b.schema)

    monkeypatch.setattr(chunk_dedup, "_recipes", clashing)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in chunk_dedup.exact_dedup(df).collect()}
    assert got == {1: 3, 2: 2, 3: 3}


def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    bits = 0
    for b in range(64):
        n = sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles)
        bits |= (2 * n > len(shingles)) << b
    return bits


def brute_components(fps):
    """(doc_id, fingerprint) -> smallest doc_id reachable over links of up to two bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(fps))


def test_simhash_against_brute_force(hard):
    small = [(i, t) for i, t in HARD]
    fps = [(i, brute_fingerprint(t, 3)) for i, t in small]
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.near_dedup(hard).collect())
    assert got == brute_components(fps)


def test_simhash_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps = [(r[0], brute_fingerprint(r[1], 3)) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in simhash.near_dedup(docs).collect()) == brute_components(fps)


def test_hot_blocks_lose_no_link(spark):
    """Chains and clouds of fingerprints, with every block over the join limit and with none."""
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(6)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(40):
            x ^= 1 << rng.randrange(63)
            fps.add(x)
            fps.add(x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {f: c for (f, _, c) in [(d, h, c) for d, h, c in brute_components([(f, f) for f in sorted(fps)])]}
    for limit in (1, 4, 10**6):
        found = {r["node"]: r["root"] for r in components(simhash.links(df, join_up_to=limit)).collect()}
        groups, truth = defaultdict(set), defaultdict(set)
        for f in fps:
            groups[found.get(f, f)].add(f)
            truth[want[f]].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_simhash_empty_and_stage(nothing, hard):
    assert simhash.near_dedup(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing).columns == nothing.columns
    kept = simhash.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    fps = [(i, brute_fingerprint(t, 5)) for i, t in HARD]
    assert kept.count() == len({c for _, _, c in brute_components(fps)})


def test_unrelated_texts_without_or_under_one_id_all_stay(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[4]), (None, texts[5]), (7, texts[5]), (8, texts[6]), (8, texts[6])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5]), (8, texts[6])]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in want)


def near_links(texts):
    """Positions of all pairs with a Jaccard similarity of 5-word shingles of 0.8 at least."""
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in split]
    return {(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_stage_against_brute_force_on_planted_near_copies(spark):
    """Copies with a few changed words, a crowd under one common passage, and a crowd of near copies of one text."""
    rng = random.Random(5)
    line = " ".join(f"common{j}" for j in range(60))
    texts = [" ".join(f"t{k}w{j}" for j in range(200)) for k in range(30)] + [f"{line} " + " ".join(f"c{k}w{j}" for j in range(40)) for k in range(30)]
    for t in list(texts):
        words = t.split()
        for n in (1, 2, 4):
            changed = list(words)
            for p in rng.sample(range(len(words)), n):
                changed[p] = f"new{rng.getrandbits(40)}"
            texts.append(" ".join(changed))
    texts += [texts[0] + f" end{k}" for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = list(range(len(texts)))
    for _ in range(4):
        for i, j in sorted(near_links(texts)):
            truth[i] = truth[j] = min(truth[i], truth[j])
    for frequent in (1 << 20, 5, 0):
        assert {r["doc_id"] for r in simhash.drop_near_duplicates(df, frequent=frequent).collect()} == set(truth)


def test_the_stage_takes_what_fingerprints_propose_and_verifies_it(spark, monkeypatch):
    rng = random.Random(9)
    texts = [" ".join(f"t{k}w{rng.randrange(900)}" for _ in range(1500)) for k in range(6)]
    texts += [t + " one more word" for t in texts[:4]] + [texts[0] + " and another", "", " ", "a b", "a  b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = {r["raw"]: r["doc_id"] for r in df.select("doc_id", F.xxhash64("text").alias("raw")).collect()}
    fps = [brute_fingerprint(t, 5) for t in texts]
    got = {frozenset((raw[r["a"]], raw[r["b"]])) for r in simhash.proposals(df, 5).collect()}
    assert got and all((fps[i] ^ fps[j]).bit_count() <= 2 for i, j in map(sorted, got))
    assert {frozenset((k, k + 6)) for k in range(4) if (fps[k] ^ fps[k + 6]).bit_count() <= 2} <= got
    nothing = lambda *_: spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr("sparkloom.operators.prefix_join._to_first", nothing)
    monkeypatch.setattr("sparkloom.operators.prefix_join._between", nothing)
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept.isdisjoint(max(p) for p in got) and set(range(6)) <= kept


def test_a_crowd_of_near_copies_is_connected(spark):
    """300 copies of one text, each with its own changed words, and 150 texts that share half their shingles but aren't copies."""
    rng = random.Random(8)
    base = [f"b{j}" for j in range(150)]
    texts = []
    for k in range(300):
        words = list(base)
        for p in rng.sample(range(150), 2):
            words[p] = f"own{k}x{p}"
        texts.append(" ".join(words))
    line = " ".join(f"common{j}" for j in range(80))
    texts += [line + " " + " ".join(f"c{k}w{j}" for j in range(60)) for k in range(150)]
    truth = list(range(len(texts)))
    for _ in range(6):
        for i, j in sorted(near_links(texts)):
            truth[i] = truth[j] = min(truth[i], truth[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == set(truth)


@pytest.mark.parametrize("limit", [1 << 17, 0])
def test_dropping_by_broadcast_or_by_join_is_alike(hard, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    got = sorted(map(str, chunk_dedup.drop_duplicates(hard).select("doc_id", "text").collect()))
    best = {}
    for i, t in HARD:
        k = "".join(c.lower() if c.isascii() else c for c in t or "")
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    assert len(got) == len(best) and {int(g.split("doc_id=")[1].split(",")[0].replace("None", "-1")) for g in got} == set(best.values())
    assert simhash.drop_near_duplicates(hard).count() == 10


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 101)} == {0} and {got[i] for i in range(1001, 1100)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0


def test_rows_helper():
    assert len(rows_of([(1, "a")])[0]) == len(SCHEMA.split(","))
