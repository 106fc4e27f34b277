"""Folds, dedup, search, near duplicates, metrics, rights and streams by hand or brute force."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import folds, scoring, search
from sparkloom.operators import components as connected
from sparkloom.operators import lineage
from sparkloom.operators.components import components
from sparkloom.operators.dedup import keep_best, keep_first, nearest_rank
from sparkloom.operators.numbering import numbered
from sparkloom.operators.records import can_follow, decide_rights, with_rights
from sparkloom.plans.corpus import checked, reused, routed
from sparkloom.plans.lexicon import standardize
from sparkloom.streaming.logs import import_new, rate_verdicts, stream_decisions

LOG = "position long, pair long, reviewer string, kind string, meaning int, fluency int, decision string"


def decided(spark, *records):
    rows = [(i, 1, *r) for i, r in enumerate(records)]
    got = folds.decide(spark.createDataFrame(rows, LOG)).collect()
    return (got[0]["status"], got[0]["approver"]) if got else None


def review(who, meaning, fluency):
    return (who, "review", meaning, fluency, None)


def approval(who, decision="approve"):
    return (who, "approval", None, None, decision)


@pytest.mark.parametrize(
    "records, want",
    [
        ([review("a", 2, 1)], ("READY_FOR_APPROVAL", None)),
        ([review("a", 2, 1), approval("z")], ("HUMAN_APPROVED", "z")),
        ([approval("z"), review("a", 2, 1)], ("READY_FOR_APPROVAL", None)),
        ([review("a", 2, 1), approval("a")], ("READY_FOR_APPROVAL", None)),
        ([review("a", 2, 1), approval("z", "reject")], ("REJECTED", "z")),
        ([review("a", 0, 2), approval("z")], ("REJECTED", "z")),
        ([review("a", 1, 2)], ("NEEDS_CORRECTION", None)),
        ([review("a", 1, 2), review("a", 2, 2)], ("READY_FOR_APPROVAL", None)),
        ([review("a", 2, 2), review("b", 2, 0), approval("z")], ("NEEDS_CORRECTION", "z")),
        ([approval("z")], None),
    ],
)
def test_decision_table(spark, records, want):
    assert decided(spark, *records) == want


def test_keep_first_and_best(spark):
    df = spark.createDataFrame([(3, "k", 0.5, "c"), (1, "k", 0.2, "a"), (2, "k", 0.5, "b"), (9, "q", 0.1, "z")], "id long, key string, score double, v string")
    assert sorted(r["v"] for r in keep_first(df, ["key"], "id").collect()) == ["a", "z"]
    best = keep_best(df, ["key"], "score", "id")
    assert best.columns == df.columns and sorted(r["v"] for r in best.collect()) == ["b", "z"]


@pytest.mark.parametrize("n", [1, 2, 101, 1000])
def test_nearest_rank(spark, n):
    df = spark.createDataFrame([(float(i),) for i in range(n)], "v double").repartition(3)
    got = nearest_rank(df, "v", {"a": 0.0, "b": 0.005, "c": 0.5, "d": 1.0}).first()
    assert list(got) == [float(round(f * (n - 1))) for f in (0.0, 0.005, 0.5, 1.0)]


def test_numbered(spark):
    ids = random.Random(1).sample(range(10**6), 500)
    got = {r["id"]: r["nth"] for r in numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(ids))}


def pairs(spark, rows):
    return spark.createDataFrame([(i, i, "s", "m1", s, g) for i, (s, g) in enumerate(rows)], "id long, doc_id long, source string, model string, source_text string, target_text string")


def test_reused_target_needs_three_families(spark):
    rows = [("red house one", "same"), ("blue house two", "same"), ("Blue house two!", "Same."), ("x y", "other")]
    assert reused(pairs(spark, rows)).count() == 0
    got = reused(pairs(spark, [*rows, ("green house", "same")])).collect()
    assert [(r["target"], r["families"]) for r in got] == [("same", 3)]


def test_template_variants_share_a_split(spark):
    got = checked(pairs(spark, [(f"I have {i} cats", f"target {i} cats yes") for i in range(30)])).select("split").distinct().collect()
    assert len(got) == 1


def test_routes(spark):
    got = {r["id"]: r["route"] for r in routed(pairs(spark, [("ok words here", "fine target here"), ("ok words here", "fine target here"), ("copy of me", "Copy of me"), ("hi", "yo")])).collect()}
    assert got == {0: "kept", 1: "duplicate", 2: "quarantine", 3: "review"}


def test_documents_with_all_terms_of_a_query(spark):
    """The same documents and scores as where all are scored and counted, without a row for each term of each."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(200)]
    asked = spark.createDataFrame([(q, x) for q, ws in {"one": "a", "two": "ab", "three": "bcd", "none": "az"}.items() for x in ws], "query string, term string")
    index = search.tokens(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    k = asked.groupBy("query").agg(F.count("*").alias("k"))
    want = {(r["query"], r["id"]): r["score"] for r in search.bm25(index, "id", asked).join(k, "query").where("met = k").collect()}
    found = search.covering(index, "id", search.term_weights(index, asked), asked)
    assert {(r["query"], r["id"]): pytest.approx(r["score"], abs=1e-9) for r in found.collect()} == want and len(want) > 50
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in shuffled


def test_bm25_by_hand(spark):
    docs = [(1, "a b"), (2, "a a c d"), (3, "e")]
    index = search.tokens(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    got = {r["id"]: r["score"] for r in search.bm25(index, "id", spark.createDataFrame([("q", "a")], "query string, term string")).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {i: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (7 / 3))) for i, tf, n in ((1, 1, 2), (2, 2, 4))}
    assert got == pytest.approx(want)


def test_query_terms_and_forms():
    assert search.query_terms('hope" OR 1=1') == (["hope", "OR", "1=1"], True)
    assert search.query_terms("a ") == (["a"], False) and search.query_terms("* ()") == ([], False)
    assert search.exact_forms(" Thank You! ") == ["thank you", "thank you.", "thank you!", "thank you?"]


def test_standard_form(spark):
    df = spark.createDataFrame([("Ther then-x other ANDE ande Miten, then",)], "a string")
    assert df.select(standardize(F.col("a"))).first()[0] == "The then-x other ANDE and Mit, the"


def test_components(spark):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4)], "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8}


def test_components_leave_few_files(spark, monkeypatch):
    """Each task of each step leaves files, so a step has the tasks that its edges need, not those of the session's shuffles."""
    parts = []
    kept = lineage.checkpointed
    monkeypatch.setattr(connected, "checkpointed", lambda df: (out := kept(df), parts.append(out.rdd.getNumPartitions()))[0])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 97)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
        assert {(r["node"], r["root"]) for r in components(path).collect()} == {(i, 0) for i in range(1, 41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 2 and max(parts[1:]) <= spark.sparkContext.defaultParallelism


def test_scores_of_perfect_and_empty():
    good = np.array(scoring.sentence_statistics("the cat sat on a mat", "the cat sat on a mat"))
    assert scoring.chrf(good) == pytest.approx(100) and scoring.bleu(good) == pytest.approx(100)
    bad = np.array(scoring.sentence_statistics("", "the cat sat on a mat"))
    assert scoring.chrf(bad) == 0 and scoring.bleu(bad) == 0


def test_clipped_matches_by_hand():
    s = scoring.sentence_statistics("the the the", "the cat the")
    assert s[18:21] == [3, 3, 2] and s[21:24] == [2, 2, 0]


def test_resamples_are_deterministic_paired_and_cover(spark):
    rows = [(name, i, scoring.sentence_statistics(f"a b c d {i}", f"a b c d {i % n}")) for name, n in (("x", 7), ("y", 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "system string, item_id long, stats array<long>")
    a, b = ({(r["system"], r["resample"]): r["sums"] for r in scoring.resampled(df.repartition(n), "item_id", 50).collect()} for n in (1, 3))
    assert a == b and len(a) == 100
    want = sum(np.outer(scoring.weights(i, 50), x) for name, i, x in rows if name == "x")
    assert [a["x", k] for k in range(50)] == want.tolist()
    scores = [scoring.chrf(want[k]) for k in range(50)]
    assert min(scores) <= scoring.chrf(sum(np.array(x) for name, _, x in rows if name == "x")) <= max(scores)


def test_gate():
    better = {"chrf": 50.0}
    assert scoring.gate(better, [{"chrf": 40.0, "p_value": 0.01}]) and not scoring.gate(better, [])
    assert not scoring.gate(better, [{"chrf": 40.0, "p_value": 0.2}])


def test_wilson(spark):
    low, high = folds.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(8, 10), (0, 0)], "k long, n long").select(low, high).collect()
    assert [round(x, 4) for x in got[0]] == [0.4902, 0.9433] and list(got[1]) == [None, None]


def test_rights_deny_by_default(spark):
    register = {
        "a": {"status": "cleared"}, "b": {"status": "cleared", "uses": {"training": "denied"}}, "c": {"components": ("a", "b"), "status": "cleared"},
        "d": {"components": ("a",), "status": "cleared"}, "e": {}, "f": {"components": ("f",), "status": "cleared"},
    }
    got = decide_rights(register, "training")
    assert {k: ok for k, (ok, _) in got.items()} == {"a": True, "b": False, "c": False, "d": True, "e": False, "f": False}
    df = with_rights(spark.createDataFrame([("a",), ("zzz",)], "s string"), "s", got)
    assert [(r["allowed"], r["reason"]) for r in df.collect()] == [(True, "cleared"), (False, "unknown_source")]


def test_transitions(spark):
    df = spark.createDataFrame([("draft", "submitted"), ("draft", "verified"), ("gone", "draft")], "a string, b string")
    assert [r[0] for r in df.select(can_follow(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_rate_limit(spark):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", 1, "view") for i, m in enumerate((1, 2, 59))] + [(9, "2024-01-01 01:00:00", 1, "view")]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").withColumn("ts", F.to_timestamp("t"))
    got = {r[0]: (r[1], r[2]) for r in rate_verdicts(df, limit=2).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 60), 9: (True, 0)}


def test_stream_of_decisions_ignores_arrival_order(spark, tmp_path):
    first = [(5, 1, "approval", "approve"), (2, 1, "review", None)]
    late = [(3, 1, "approval", "reject"), (7, 2, "review", None)]
    schema = "position long, pair long, kind string, decision string"
    for k, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = {}
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def keep(batch, _):
        out.update({r["pair"]: (r["newest"], r["approved"], r["decision"]) for r in batch.collect()})

    stream_decisions(log).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert out == {1: (2, 5, "approve"), 2: (7, -1, None)}


def test_import_is_idempotent(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "event_id")
    target = f"{tmp_path}/log"
    assert import_new(rows.where("event_id < 6"), target, "event_id") == 6
    assert import_new(rows, target, "event_id") == 4 and import_new(rows, target, "event_id") == 0
    assert spark.read.parquet(target).count() == 10
