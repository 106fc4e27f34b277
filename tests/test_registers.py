"""Rights registers, matched changes, record makers and conformance by hand and brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import changesets
from sparkloom.operators.changesets import apply_matched
from sparkloom.operators.conformance import RULES, record_faults
from sparkloom.operators.record_makers import changeset_id, draft_items, owner_records
from sparkloom.operators.rights import EVIDENCE, authorized, decision_errors
from sparkloom.plans.conformance import records


def allowed(sources, components):
    """Reasons by looking at every component of every source."""
    def reason(s):
        if not sources[s]:
            return "needs_review"
        seen, todo, refused = {s}, [s], False
        while todo:
            for c in components.get(todo.pop(), ()):
                refused |= not sources.get(c, False)
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        if refused:
            return "component_not_cleared"
        return "circular_components" if any(on_cycle(x) for x in seen) else ""

    def on_cycle(x):
        seen, todo = set(), list(components.get(x, ()))
        while todo:
            y = todo.pop()
            if y == x:
                return True
            if y not in seen:
                seen.add(y)
                todo += components.get(y, ())
        return False

    return {s: reason(s) for s in sources}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_to_a_fixpoint(spark, seed):
    rng = random.Random(seed)
    sources = {i: rng.random() < 0.93 for i in range(60)}
    components = {i: [j for j in {rng.randrange(64) for _ in range(rng.choice((0, 1, 1, 2)))}] for i in range(60)}
    for i in range(30, 45):
        components[i], sources[i] = [i - 1], True  # a long chain
    own = spark.createDataFrame([(i, "train", "cleared" if ok else "needs_review", "legacy", []) for i, ok in sources.items()], "source long, use string, status string, basis string, errors array<string>")
    edges = spark.createDataFrame([(i, j) for i, js in components.items() for j in js], "source long, component long")
    got = {r["source"]: (r["allowed"], r["reason"]) for r in authorized(own, edges).collect()}
    assert got == {s: (why == "", why) for s, why in allowed(sources, components).items()}


GOOD = {
    "use": "train", "path": "restricted", "evidence": "letter", "evidence_type": "written_permission", "decided_on": "2024-01-02", "decided_by": "O01", "verified_by": ["E01"], "underlying_rights_checked": True,
    "license": None, "attribution": None, "grant_scope": ["train"], "provider_terms": None, "origin": "third_party", "attested_on": None, "attribution_required": False, "provider_derived": False, "disputed": False,
}
SCHEMA = "use string, path string, evidence string, evidence_type string, decided_on string, decided_by string, verified_by array<string>, underlying_rights_checked boolean, license string, attribution string, grant_scope array<string>, provider_terms string, origin string, attested_on string, attribution_required boolean, provider_derived boolean, disputed boolean"


@pytest.mark.parametrize(
    "changed, errors",
    [
        ({}, []), ({"path": "other"}, ["path"]), ({"path": None}, ["path"]), ({"evidence": " "}, ["no_evidence"]), ({"evidence_type": "rumour"}, ["evidence_type"]), ({"decided_on": "May"}, ["decided_on"]),
        ({"decided_by": "Ann"}, ["decided_by"]), ({"verified_by": None}, ["no_independent_verifier"]), ({"verified_by": ["O01"]}, ["no_independent_verifier"]), ({"verified_by": ["E01", "x"]}, ["verified_by"]),
        ({"underlying_rights_checked": False}, ["underlying_rights"]), ({"attribution_required": True}, ["attribution"]), ({"provider_derived": True}, ["provider_terms"]),
        ({"path": "open_license"}, []), ({"path": "open_license", "disputed": True}, ["path_not_open"]), ({"path": "open_license", "grant_scope": []}, ["grant_scope"]),
        ({"path": "open_license", "evidence_type": "open_license", "license": "CC-BY-4.0"}, ["attribution"]), ({"path": "open_license", "evidence_type": "open_license", "license": "own"}, ["license_unknown"]),
        ({"path": "open_license", "evidence_type": "open_license", "license": "CC-BY-NC-4.0", "attribution": "us", "use": "redistribute"}, ["license_use"]), ({"path": "owner_original", "evidence_type": "owner_authorship"}, ["path_not_open", "owner_decides"]),
        ({"path": "owner_original", "evidence_type": "owner_authorship", "origin": "owner_original", "attested_on": "2024-01-03"}, ["before_provenance"]),
    ],
)
def test_what_keeps_a_clearance_from_being_valid(spark, changed, errors):
    assert len(EVIDENCE) == 3
    row = spark.createDataFrame([tuple((GOOD | changed).values())], SCHEMA)
    assert row.select(decision_errors(F.lit(False))).first()[0] == errors


def test_changes_one_after_another(spark):
    live = [(1, "a", "x; y", "one  two", None), (2, "a", "x ;  y", "other", "n1"), (3, "b", "p", "d", None), (4, "c", None, "", None)]
    changes = [
        (10, "set_text", "a", "x;y", "z"), (11, "set_definition", "a", "one two", "three"), (12, "set_definition", "a", "three", "four"), (13, "set_definition", "a", "three", "five"), (14, "add_note", "a", None, "n1"),
        (15, "add_note", "a", None, "n1"), (16, "set_text", "b", "p ", "q;; r "), (17, "set_text", "b", "q;r", "s"), (18, "set_text", "zz", "p", "q"), (19, "merge_entries", "a", None, None), (20, "set_text", "c", "", "x"), (21, None, "a", None, None),
    ]
    rows, outcomes = apply_matched(spark.createDataFrame(live, "id long, headword string, text string, definition string, notes string"), spark.createDataFrame(changes, "position long, op string, headword string, before string, after string"))
    assert {r["position"]: r["outcome"] for r in outcomes.collect()} == {
        10: "ambiguous", 11: "applied", 12: "applied", 13: "no_match", 14: "applied", 15: "no_match", 16: "applied", 17: "applied", 18: "unknown_headword", 19: "not_shown", 20: "no_match", 21: "not_shown",
    }
    assert {tuple(r) for r in rows.collect()} == {(1, "a", "x; y", "four", "n1"), (2, "a", "x ;  y", "other", "n1"), (3, "b", "s", "d", None), (4, "c", None, "", None)}


def test_a_changesets_name_depends_on_its_operations_alone(spark):
    rows = [(f"d{i}", "annotate_sense", "human", False, f"value={i}") for i in range(20)] + [("x", "needs_input", "human", False, "reason=r")]
    schema = "decision string, op string, origin string, provider_derived boolean, payload string"
    name = lambda r, n: tuple(changeset_id(spark.createDataFrame(r, schema).repartition(n)).first())
    assert name(rows, 1) == name(rows[::-1], 5) == name(rows[:-1], 2) and name(rows, 1)[1] == 20
    assert name(rows[1:], 1)[0] != name(rows, 1)[0] and name(rows[-1:], 1)[1] == 0


def test_owner_records_and_drafts(spark):
    reviews = [(1, 2, 1, None, "t"), (2, 0, 1, "fix", "t"), (3, 1, 1, " new  text ", "old"), (4, 2, 2, "same", " same "), (5, 1, 1, "", "t"), (6, 1, 0, "fix", None)]
    got = {r["pair"]: tuple(r)[1:] for r in owner_records(spark.createDataFrame(reviews, "pair long, meaning int, fluency int, correction string, shown string")).collect()}
    assert got == {
        1: ("approval", "approve", None, None, None), 2: ("revision", None, "t", "fix", "meaning_rejects"), 3: ("revision", None, "old", "new text", None),
        4: ("revision", None, "same", "same", "nothing_changes"), 6: ("revision", None, "", "fix", "text_unknown"),
    }
    sheet = spark.createDataFrame([("1", "news", "a", "b", None), ("2", "news", "a", " ", "n"), ("3", "sport", "a", "b", None)], "id string, topic string, source_text string, translation string, notes string")
    assert [(r["outcome"], r["references"]) for r in draft_items(sheet, ("news",), "en-de", "t", "own").orderBy("id").collect()] == [("pending", ["b"]), ("blank", None), ("unknown_topic", ["b"])]


def test_every_rule_is_broken_somewhere(spark):
    found = record_faults(records(spark, "/root/testdata/sf0.01")).select("fault").distinct().collect()
    assert {r["fault"] for r in found} == set(RULES)
    clean = records(spark, "/root/testdata/sf0.01").where("line % 61 = 60 AND length(trim(source_text)) > 20").where(~F.col("source_text").rlike(r"[\x00-\x1f]"))
    assert clean.count() > 0 and record_faults(clean, "line").count() == 0


def test_a_change_looks_at_the_rows_it_matches(monkeypatch):
    """Rows are read once and changes once, however many rows a headword has; outcomes and rows are those of a search through all."""
    rng = random.Random(4)
    read = Counter()
    for name in ("_flat", "_parts"):
        monkeypatch.setattr(changesets, name, lambda x, f=getattr(changesets, name), name=name: read.update([name]) or f(x))
    flat = lambda x: (x or "").split()
    parts = lambda x: [flat(y) for y in (x or "").split(";") if flat(y)]
    there, plain = changesets._Headword(), []
    for k in range(300):
        row = [k, rng.choice(["", None, f"a;{k % 150}", f" b {k} ;c"]), rng.choice([None, "", f"d  {k % 200}"]), rng.choice([None, "", "x", "n1; x", f"y{k % 5}"])]
        there.add(*row)
        plain.append(row)
    for _ in range(2000):
        op, x, y = rng.choice(["set_text", "set_definition", "add_note"]), rng.choice(plain), rng.choice([None, "", ";", "n1", "n2", f"b {rng.randrange(9)}; c", f"a;{rng.randrange(150)}"])
        before = x[1] if op == "set_text" else x[2]
        if op == "add_note":
            found = [r for r in plain if y and y not in (r[3] or "")]
            want = "applied" if found else "no_match"
            for r in found:
                r[3] = f"{r[3]}; {y}" if r[3] else y
        else:
            found = [r for r in plain if (parts(r[1]) and parts(r[1]) == parts(before) if op == "set_text" else flat(r[2]) == flat(before))]
            want = "applied" if len(found) == 1 else "ambiguous" if found else "no_match"
            if len(found) == 1:
                found[0][1 if op == "set_text" else 2] = " ; ".join(" ".join(z) for z in parts(y)) if op == "set_text" else y
        assert there.apply(op, before, y) == want
    assert sorted(there.all_rows()) == sorted(map(tuple, plain))
    assert read["_parts"] < 300 + 3 * 2000
