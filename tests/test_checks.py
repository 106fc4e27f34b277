"""Release gate, review folds and planning on hand-made cases; tiered retrieval edges."""

from pyspark.sql import functions as F

from sparkloom.operators import checks
from sparkloom.plans.lookup import cascade, named_templates, pair_tiers

RECORD = "pos long, id string, source string, target string, split string, review_status string, contributor string, reviewer string, approver string, approval string, approval_version string, source_id string, may_train boolean, origin string, family string"


def record(pos, **changes):
    fine = dict(pos=pos, id=f"i{pos}", source=f"s {pos}", target=f"t {pos}", split="train", review_status="HUMAN_APPROVED", contributor="c", reviewer="r", approver="e", approval=None, approval_version="1", source_id="x", may_train=True, origin="en", family=f"f{pos}")
    return tuple((fine | changes)[c.split()[0]] for c in RECORD.split(", "))


def test_gate_codes_by_hand(spark):
    rows = [
        record(1), record(2, id="i1"), record(3, source="S  1", target="t 1", family="f1"), record(4, source="s 1", target="t 1", split="test"),
        record(5, source="s 1", split="test"), record(6, family="f1", split="test"), record(7, id=None, split="dev", may_train=None, origin=None),
        record(8, reviewer="C "), record(9, approver="R"), record(10, approval="owner_sole"), record(11, approval="owner_sole", reviewer="O", approver="o", contributor="o"),
        record(12, target=None, approver=" ", approval_version=None, source_id="", review_status=None, family=""),
    ]
    got: dict = {}
    for r in checks.gate_codes(spark.createDataFrame(rows, RECORD), "o").collect():
        got.setdefault(r["pos"], set()).add(r["code"])
    assert got == {
        2: {"duplicate_id"}, 3: {"duplicate_pair"}, 4: {"duplicate_pair_across_splits"}, 5: {"source_across_splits"}, 6: {"split_family_leakage"},
        7: {"missing_id", "invalid_split", "training_rights_not_cleared", "invalid_origin_language"}, 8: {"self_approval"}, 9: {"reviewer_is_approver"},
        10: {"owner_sole_not_owner"}, 12: {"missing_target", "missing_review_identity", "missing_approval_version", "missing_provenance", "not_human_approved", "missing_split_family_id"},
    }


def test_sense_decisions_by_hand(spark):
    log = [
        (1, 1, "review", "a", "correct", None, None, None), (2, 1, "approval", "b", None, None, "approve", None),
        (3, 2, "review", "a", "correct", None, None, None), (4, 2, "approval", "a", None, None, "approve", "owner_sole"),
        (5, 3, "review", "a", "fix", "x", None, None), (6, 4, "review", "a", "wrong", None, None, None), (7, 4, "review", "a", "correct", None, None, None),
        (8, 5, "approval", "b", None, None, "approve", None), (9, 6, "approval", "b", None, None, "approve", None), (10, 6, "review", "a", "correct", None, None, None),
    ]
    df = spark.createDataFrame(log, "position long, sense long, kind string, reviewer string, choice string, correction string, decision string, approval string")
    got = {r["sense"]: (r["status"], r["approver"], r["corrections"], r["sole"]) for r in checks.decide_senses(df).collect()}
    assert got == {
        1: ("HUMAN_APPROVED", "b", 0, False), 2: ("HUMAN_APPROVED", "a", 0, True), 3: ("NEEDS_CORRECTION", None, 1, False),
        4: ("READY_FOR_APPROVAL", None, 0, False), 6: ("READY_FOR_APPROVAL", None, 0, False),
    }


def test_notice_flags(spark):
    df = spark.createDataFrame([("[Native/editorial review required] [Working reference 2]",), (None,), ("none",)], "n string")
    assert [r[0] for r in df.select(checks.notice_flags(F.col("n"))).collect()] == [["native_editorial_review_required", "working_reference"], [], []]


def test_cascade_prefers_close_matches(spark):
    rows = [(1, "bolt", "tin", False, 1.0, 1), (2, "bolt head", "tin ; promo", True, 1.0, 2), (3, "bolts", "promo", False, 1.0, 3), (4, "red bolt", "promotion x", False, 9.0, 1)]
    got = cascade(spark.createDataFrame(rows, "id long, headword string, meanings string, flagged boolean, confidence double, tier int")).collect()
    order = lambda d, q: [r["id"] for r in sorted(got, key=lambda r: r["place"]) if (r["direction"], r["query"]) == (d, q)]
    assert order("headword", "bolt") == [1, 3, 2, 4]
    assert order("meaning", "promo") == [3, 2, 4]  # flagged later; then all words by beginning
    assert order("meaning", "omo") == [2, 4, 3][::1] or set(order("meaning", "omo")) == {2, 3, 4}


def test_pair_tiers(spark):
    rows = [(1, "In the.", 0.1), (2, "in the théatre", 0.9), (3, "then in", 0.9), (4, "in the thing it is", 0.3), (5, "", 1.0)]
    got = pair_tiers(spark.createDataFrame(rows, "id long, source_text string, score double"), ("in the", "in the théa")).collect()
    by = {q: [(r["id"], r["exact"]) for r in sorted(got, key=lambda r: r["place"]) if r["query"] == q] for q in ("in the", "in the théa")}
    assert by == {"in the": [(1, True), (3, False), (2, False)], "in the théa": [(2, False)]}


def test_named_templates_mask_names_only(spark):
    rows = spark.createDataFrame([(1, "Mary saw 3 cats"), (2, "Anna saw 7 cats"), (3, "saw"), (4, "")], "id long, line string")
    names = spark.createDataFrame([("mary",), ("anna",)], "word string")
    got = {r["id"]: r["template"] for r in named_templates(rows, ["id"], "line", names).collect()}
    assert got[1] == got[2] != got[3] and len(got) == 4
