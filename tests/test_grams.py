"""Frequent words, pairs and triples against counting them all; what travels for rare ones."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import grams
from sparkloom.operators.grams import frequent_grams
from sparkloom.operators.shingles import spelled_words
from sparkloom.plans import registry


def said(text):
    return re.findall(r"[a-z]+(?:['-][a-z]+)*'?", text or "")


def counted(rows, least):
    met = Counter((src, n, " ".join(w[k : k + n])) for src, text in rows for w in [said(text)] for n in (1, 2, 3) for k in range(len(w) - n + 1))
    return {g: uses for g, uses in met.items() if uses >= least}


ODD = ["", None, "one", "one two", "a'b ''c' d''e -f- g-h-i j'-k 'l", "é one ß two 中", "a-'b x'y' x'y'z", "12 - '"]


def test_words_as_the_pattern_cuts_them():
    words, per_text = spelled_words([(t or "").encode() for t in ODD])
    assert [w.decode() for w in words.to_pylist()] == [w for t in ODD for w in said(t)] and per_text.tolist() == [len(said(t)) for t in ODD]
    assert len(spelled_words([])[0]) == 0


@pytest.mark.parametrize("choices", [{}, {"buckets": 0, "gathered": 1}, {"buckets": 3, "most_bits": 8, "gathered": 50}])
def test_against_counting_all(spark, choices):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcde" for b in "xyz'"]
    rows = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for _ in range(80)] + [("en", t) for t in ODD * 2]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least in (2, 5):
        got = {tuple(r)[:3]: r["uses"] for r in frequent_grams(F.col("lang"), F.col("text"), docs, least, **choices).collect()}
        assert got == counted(rows, least)


def test_texts_cut_in_pieces_keep_their_grams(monkeypatch):
    rows = [("a", "u v w x y z u v"), ("b", "k"), ("a", "p q"), (None, "u v w")]
    batch = pa.RecordBatch.from_pydict({"src": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(grams, "AT_ONCE", 3)
    met = Counter()
    for src, words, left in grams._pieces(iter([batch])):
        assert len(left) <= 3
        for n in (1, 2, 3):
            at = grams._gram_hashes(src, grams.hashed_words(words), left, n)[0]
            found, _, uses = grams._told_apart(words, at, n, np.zeros(len(at), np.uint64))
            met.update({(src, n, g.decode()): int(u) for g, u in zip(found.to_pylist(), uses)})
    assert met == counted(rows, 1)


def test_rare_grams_hardly_travel(spark, tmp_path):
    """Small tables are dealt out in each of two readings; less than the texts take is written besides. Each triple as text would take over ten times as much."""
    rng = random.Random(1)
    rows = [(k, "en", " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400))) for k in range(500)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    written = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(shared) for f in files) + spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = registry.queries()["ngram_counts"](spark, str(tmp_path)).collect()
    assert {tuple(r)[1:3]: r["uses"] for r in got} == {g[1:]: u for g, u in counted([r[1:] for r in rows], 5).items()}
    assert written() - before < 3 * sum(len(r[2]) for r in rows)
