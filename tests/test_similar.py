"""The exact similarity join against brute force, in crowds too."""

import os
import random
import re
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.operators import prefix_join
from sparkloom.operators.prefix_join import similar_groups
from sparkloom.operators.shingles import loose_shingles, word_shingles


def loose(text):
    words = [re.sub(r"\d+", "#", w.lower()) for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", text)]
    return {(w,) for w in words} | set(zip(words, words[1:]))


def runs(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def roots(sets, threshold):
    """For each set with a similar one the least position it is connected to."""
    root = list(range(len(sets)))
    linked = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in {k for pair in linked for k in pair}}


def found(spark, texts, hasher, threshold, **choices):
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    return {r["node"]: r["root"] for r in similar_groups(df, hasher, threshold, **choices).collect()}


def mixed(rng):
    """Texts of several lengths that share passages, with near copies on both sides of the threshold."""
    passages = [[f"p{k}w{j}" for j in range(rng.randrange(20, 60))] for k in range(4)]
    texts = []
    for k in range(40):
        base = [f"t{k}w{j}" for j in range(rng.randrange(5, 40))]
        for p in rng.sample(passages, rng.randrange(3)):
            base = base + p
        texts.append(base)
        for changes in (1, 2, 4, 7):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = f"new{rng.getrandbits(30)}"
            texts.append(copy)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("frequent", [1 << 20, 7, 0])
def test_against_brute_force(spark, frequent):
    texts = mixed(random.Random(frequent)) + ["", "...", "Amen", "amen!", "a b", "A b"]
    assert found(spark, texts, loose_shingles, 0.8, frequent=frequent) == roots([loose(t) for t in texts], 0.8)
    assert found(spark, texts, partial(word_shingles, width=5), 0.8, frequent=frequent) == roots([runs(t) for t in texts], 0.8)


def crowd(n):
    """Texts under one long passage, cross similarity about 0.735, of which every two that follow are at about 0.83."""
    line = " ".join(f"common{j}" for j in range(170))
    texts = [f"{line} " + " ".join(f"pair{k // 2}w{j}" for j in range(12)) + " " + " ".join(f"own{k}w{j}" for j in range(19)) for k in range(n)]
    return [t.translate(str.maketrans("0123456789", "abcdefghij")) for t in texts]


def test_a_crowd_hides_no_pair(spark):
    small = [loose(t) for t in crowd(6)]
    assert 0.8 < len(small[0] & small[1]) / len(small[0] | small[1]) < 0.85 and 0.7 < len(small[0] & small[2]) / len(small[0] | small[2]) < 0.77
    texts = crowd(2000)
    assert found(spark, texts, loose_shingles, 0.8) == {k: k // 2 * 2 for k in range(2000)}


def test_a_crowd_of_copies_is_one_group(spark):
    """Near copies of one text, far more than are grouped together, each with a changed word of its own."""
    base = [chr(97 + j // 26) + chr(97 + j % 26) for j in range(60)]
    texts = [" ".join([*base[: k % 60], f"own{chr(97 + k // 26)}{chr(97 + k % 26)}", *base[k % 60 + 1 :]]) for k in range(300)]
    assert found(spark, texts, loose_shingles, 0.8) == dict.fromkeys(range(300), 0)


def test_parts_of_a_frequent_shingle(spark):
    """A frequent shingle's rows are grouped in parts; their firsts meet."""
    rows = [(7, 1 + k % 3, k, 10, 0) for k in range(9)] + [(8, 0, 1, 10, 1), (9, 1, 2, 10, 1), (10, 0, 3, 10, 1), (10, 0, 3, 10, 1), (10, 0, 4, 10, 1)]
    df = spark.createDataFrame(rows, "token long, salt int, key long, n int, p int").coalesce(1).sortWithinPartitions("token", "salt", "key")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        met = df.mapInArrow(prefix_join._grouped, prefix_join._MET).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["token"], r["key"], r["first"]) for r in met) == sorted([(7, k, k % 3) for k in range(9)] + [(9, 2, 2), (10, 3, 3), (10, 4, 3)])
    pairs = prefix_join._to_first(spark.createDataFrame(met, prefix_join._MET), 0.8).collect()
    # And each with the hub: 4 is in two groups.
    assert {tuple(r) for r in pairs} >= {(k, k % 3) for k in range(3, 9)} | {(1, 0), (2, 0), (4, 3)} | {(k, 4) for k in range(5, 9)} | {(4, k) for k in range(4)}


def test_shingles_of_many_texts():
    texts = [b"", b"  a B\tc d e f  ", b"a b c d e f", b"x", b"a b", "\xe9 2 3 4 5 \xe9 2 3 4 5".encode(), b"b a"]
    sets = word_shingles(texts, 5)
    assert [len(s) for s in sets] == [1, 2, 2, 1, 1, 5, 1]
    assert sets[1].tolist() == sets[2].tolist() and len({s.tobytes() for s in sets}) == 6
    assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
    assert word_shingles([], 5) == [] and loose_shingles([]) == []
    assert [len(s) for s in loose_shingles([b"", b"A b 12", b"a B 7", b"one"])] == [0, 5, 5, 1]


def test_sketches_rule_out_what_is_far_and_nothing_similar(spark):
    rng = random.Random(5)
    close = far = 0
    for _ in range(400):
        one = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randrange(1, 900))], np.uint64))
        kept = one[np.array([rng.random() < rng.choice((0.3, 0.95)) for _ in one], bool)]
        two = np.union1d(kept, np.array([rng.getrandbits(64) for _ in range(rng.randrange(0, 40))], np.uint64))
        least = prefix_join._differ_at_least(prefix_join._sketch(one), prefix_join._sketch(two))
        assert least <= len(np.setxor1d(one, two))
        both = len(np.intersect1d(one, two))
        if both < 0.6 * (len(one) + len(two) - both):
            far += 1
            close += least <= (len(one) + len(two)) / 9
    assert far > 100 and close < 0.1 * far
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join([*words[:290], "x"]), " ".join(words[::2])]
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "a long, b long")
    assert [tuple(r) for r in prefix_join._plausible(pairs, df, partial(word_shingles, width=1), 0.8).collect()] == [(1, 0)]


def test_loose_words_at_odd_places():
    texts = ["a'b ''c' d’’e’1 'x", "", "'", "É'É ß٣-x_y", "中文 \U0001d400́z", "A1b22"]
    got = loose_shingles([t.encode() for t in texts] + [b"\xffa'b\xc3"])
    alone = [loose_shingles([t.encode()])[0] for t in texts]
    assert all(np.array_equal(x, y) for x, y in zip(got, alone))
    assert [len(x) for x in got] == [len(loose(t)) for t in [*texts, "a'b"]]


def test_rows_that_meet_none_of_their_group_go(monkeypatch):
    """Of small groups exactly the rows that can be similar to another; of large ones, of a batch's first and last and of a frequent shingle's parts all."""
    monkeypatch.setattr(prefix_join, "SMALL", 6)
    rng = random.Random(4)
    rows = []
    for token, size in enumerate([3, 2, 5, 1, 6, 7, 4, 6, 2, 3]):
        for key in range(size):
            n = rng.randrange(20, 40)
            rows.append((token, int(token == 8), key, n, rng.randrange(0, 8), 0, 0, 0))
    kept = {tuple(r.values())[:3] for b in prefix_join._that_meet(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], list("tskxyabc"))]), 0.8) for r in b.to_pylist()}

    def meet(x, y):
        (n, p), (m, q) = x[3:5], y[3:5]
        return min(n, m) >= 0.8 * max(n, m) and min(n - p, m - q) >= (n + m) * 0.8 / 1.8 - 1e-9

    def stays(r):
        group = [x for x in rows if x[:2] == r[:2]]
        return r[0] in (0, 9) or r[1] or len(group) > 6 or any(meet(r, x) for x in group if x is not r)

    assert kept == {r[:3] for r in rows if stays(r)} and 20 < len(kept) < len(rows)
    assert [b.num_rows for b in prefix_join._that_meet(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 8, list("tskxyabc"))]), 0.8)] == [0]


def test_little_travels_of_texts_that_are_near_none(spark):
    """Less is written than the texts take, though every text shares rare words with some others: such pairs are too far apart to be similar."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" if rng.random() < 0.7 else f"x{rng.getrandbits(40)}" for _ in range(rng.randrange(100, 900))) for _ in range(700)]
    texts += [t + " one more" for t in texts[:20]]
    shared = spark.conf.get("spark.checkpoint.dir")
    written = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(shared) for f in files) + spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    df = spark.createDataFrame([(k, t.translate(str.maketrans("0123456789", "abcdefghij"))) for k, t in enumerate(texts)], "key long, text string").coalesce(3)
    before = written()
    assert {r["node"]: r["root"] for r in similar_groups(df, loose_shingles, 0.8).collect()} == {k: k % 700 for k in [*range(20), *range(700, 720)]}
    assert written() - before < sum(map(len, texts))
