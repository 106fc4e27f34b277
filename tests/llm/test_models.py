"""Classifiers by held-out accuracy; shards and packing by their laws."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import packing, quality, sharding, toxicity
from sparkloom.llm.fitting import labelled, remainder

from .conftest import HARD

SF = "/root/testdata/sf0.1"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels")]


@pytest.mark.parametrize("module, label, threshold, least", [(quality, "quality", 0.3, (0.97, 0.97)), (toxicity, "toxic", 0.5, (0.98, 0.9))])
def test_held_out_accuracy(tables, module, label, threshold, least):
    docs, labels = tables
    got = module.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == got["doc_id"].map(held_out)).all()
    assert (got["predicted"] == (got["score"] >= threshold)).all()
    j = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    rates = [(j.loc[j[label] == v, "predicted"] == v).mean() for v in (0, 1)]
    assert rates[0] > least[0] and rates[1] > least[1], rates


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(module, hard, nothing, labels):
    got = module.score(hard, labels)
    assert got.count() == len(HARD) and got.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert module.score(nothing, labels).count() == 0
    unlabelled = module.score(hard, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in unlabelled] == [0.5 if module is quality else 0.0]


def test_labels_of_held_out_rows_are_not_used(tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(remainder("doc_id") == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def test_scores_from_a_fixed_model(spark):
    """Scores of the trained model, recomputed text by text without Spark."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, labels).collect()}
    for i, t in texts.items():
        words = {w for w in re.findall(r"\w+", (t or "").lower())}
        starts = Counter(w[:n] + "*" for w in words for n in range(3, 9) if len(w) > n)
        raw = model.bias + sum(model.weights.get(w, 0) for w in words)
        raw += sum(model.weights.get(f"{x}{k if k > 1 else ''}", 0) for x, n in starts.items() for k in range(1, min(n, 3) + 1))
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9
    ranker = quality.train(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, labels).collect()}
    for i, t in texts.items():
        z = np.clip((np.array(quality.features((t or "").encode())) - ranker.mean) / ranker.scale, -8, 8)
        raw = ranker.slope * (float(z @ ranker.weights) - ranker.cut) + np.log(3 / 7)
        assert abs(scored[i] - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-9


def test_a_doc_id_with_both_labels_is_not_learnt_from(spark):
    ids = [i for i in range(1, 40) if not held_out(i)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(ids[0], "a second text")], "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[1], 1 - ids[1] % 2), (ids[2], ids[2] % 2)], "doc_id long, quality int")
    got = Counter(r["doc_id"] for r in labelled(docs, marked, "quality", 100).collect())
    assert got == {i: 1 for i in ids if i != ids[1]}


def test_quality_stage(hard, nothing, labels):
    kept = quality.keep_good(hard, labels)
    assert kept.columns == hard.columns and kept.count() <= len(HARD)
    assert quality.keep_good(nothing, labels).count() == 0
    assert quality.keep_good(hard, labels.limit(0)).count() == len(HARD)


def test_ranking_learns_preferences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] - 0.5 * x[:, 3] > 0).astype(int)
    m = quality.fit(x, y, pairs=4000)
    assert ((m.score(x) >= quality.THRESHOLD) == y).mean() > 0.95
    assert quality.fit(x, np.ones(600, int)) is None


def test_features_are_finite_for_any_text():
    for t in [b"", b" ", b"\xff\xfe", b"a" * 100_000, b"\n" * 50, "漢字🙂".encode() * 999]:
        f = quality.features(t)
        assert len(f) == len(quality._NAMES) and np.isfinite(f).all()


def test_top_word_counts_every_word_of_any_length():
    at = quality._NAMES.index("top_word")
    for n in (20, 100, 5000):
        # The common word stands only where a stride from the first word on does not look.
        words = [f"w{i}" if i % 2 == 0 else "same" for i in range(n)]
        assert quality.features(" ".join(words).encode())[at] == 0.5


def test_identity_terms_do_not_move_scores():
    """Toxic texts mention a group more often; with the penalty the term's weight all but goes."""
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(50)]
    rows, y = [], []
    for i in range(800):
        toxic = i % 2
        ws = set(rng.choice(common, 12))
        if toxic:
            ws.add(str(rng.choice(["idiot", "scum", "moron"])))
        if rng.random() < (0.6 if toxic else 0.15):
            ws.add("immigrant")
        rows.append(ws)
        y.append(toxic)
    plain, fair = (toxicity.fit(rows, np.array(y), penalty=p) for p in (0.0, 20.0))
    assert abs(fair.weights.get("immigrant", 0)) < 0.3 * abs(plain.weights["immigrant"])
    right = [(fair.score(ws) >= 0.5) == bool(t) for ws, t in zip(rows, y)]
    assert np.mean(right) > 0.97


@pytest.mark.parametrize("width", [4096, 3])
def test_shard_laws(hard, nothing, width, monkeypatch):
    monkeypatch.setattr(sharding.assign_groups, "__defaults__", (width,))
    got = sharding.shard(hard).toPandas()
    assert len(got) == len(HARD) and got["shard"].between(0, 23).all() and (got["law"] == "bytes").all()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    sizes = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in HARD)
    assert sorted(zip(got["size"], got["text_crc32"])) == sizes
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("width", [16_384, 50, 7])
def test_no_width_parts_a_group(spark, width, monkeypatch):
    """Groups under a fair share stay whole at any width; which are parted depends on the rows alone."""
    monkeypatch.setattr(sharding.assign_groups, "__defaults__", (width,))
    rows = [(i, f"group {i % 97} " * 30) for i in range(2000)] + [(i, "copy" * 60) for i in range(2000, 3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    shards = got.groupby("text")["shard"].nunique()
    assert shards["copy" * 60] == 24 and shards.drop("copy" * 60).max() == 1
    if width > 50:
        sums = got.groupby("shard")["size"].sum()
        assert sums.max() <= 1.01 * sums.mean()


def test_shards_are_balanced_and_keep_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sharding.shard(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() - sums.min() <= 0.01 * sums.mean()
    assert got.groupby("text")["shard"].nunique().max() == 1


def test_a_group_over_a_fair_share_is_cut(spark):
    docs = spark.createDataFrame([(i, "copy" * 50 if i < 700 else f"text {i} " * 20) for i in range(2000)], "doc_id long, text string")
    sums = sharding.shard(docs).toPandas().groupby("shard")["size"].sum()
    assert len(sums) == 24 and sums.max() <= 1.01 * sums.mean()


def test_differencing_beats_greedy_by_hand():
    sums = np.zeros((5, 2), np.int64)
    sums[:, 0] = [8, 7, 6, 5, 4]
    final, place = sharding.difference(sums)
    # The textbook run of the method: 16 and 14.
    assert sorted(final.tolist()) == [14, 16]
    assert [sum(v for v, p in zip([8, 7, 6, 5, 4], place[:, 0]) if p == k) for k in (0, 1)] == final.tolist()


def encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


ODD = ["İstanbul ΑΣ ΑΣ. H̱ x <|endoftext|> a<|startoftext|>b it's I'LL don't ... ,, a.b,  x y\x1cz", "é É Ⅷ ² x2,5. ab, ab. ß. é,", "é É Å"]


def test_word_ids_equal_the_tokenizer(spark):
    texts = ODD + [t or "" for _, t in HARD] + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for remembered in (10**6, 50):
        ids = packing.WordIds(packing.vocabulary(), remembered)
        got = [np.frombuffer(b, "<u4").tolist() for k in range(0, len(texts), 32) for b in ids.of([t.encode() for t in texts[k : k + 32]])]
        assert got == [x[:-1] for x in encode(texts)]


@pytest.mark.parametrize("per_bucket", [20_000, 5])
def test_packing_laws(hard, per_bucket):
    got = packing.pack(hard, per_bucket=per_bucket).toPandas()
    ids = encode([t for _, t in HARD])
    want = [(i if i is not None else -1, p, s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes())) for (i, _), x in zip(HARD, ids) for p, s in enumerate(range(0, len(x), 4096))]
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 4096 and (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_packing_is_near_the_bound(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs).toPandas()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 2
    assert packing.pack(nothing).count() == 0


def test_no_bin_holds_three_large_items():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 4096, 3000)
    bins = packing.best_fit(n, 4096)
    f = pd.DataFrame({"n": n, "bin": bins})
    assert f.groupby("bin")["n"].sum().max() <= 4096
    assert f[f["n"] > 4096 // 3].groupby("bin").size().max() <= 2
    assert f["bin"].nunique() <= 1.12 * n.sum() / 4096
