"""Records of the documents table with a fault for every rule, and what is found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conformance import RULES, file_faults, record_faults, rules_sql
from ..sources.views import table
from .registry import query

# What a field is wrong in, by which documents: the k-th of every 61 has fault k. Written in SQL that both engines take.
_FAULTS = {
    "format_version": {0: "'0.9'"}, "kind": {1: "'poem'", 2: "'dictionary_sense'"}, "tier": {3: "'tin'", 37: "'gold'"}, "split": {4: "NULL", 36: "'train'", 38: "'train'"}, "origin": {5: "'found'", 6: "'machine_generated'", 7: "'machine_generated'", 37: "'machine_generated'"},
    "source_text": {8: "NULL", 9: "'  '", 10: "concat(' ', {body})", 11: "concat({body}, '\u2028', 'x')", 12: "concat({body}, '\u221a\u00a9')"},
    "target_text": {13: "NULL", 14: "''", 15: "concat({body}, ' ')", 16: "concat({body}, '\x01', 'x')", 17: "concat({body}, '\u221a\u00a9')"},
    "standard_text": {18: "concat({body}, 'y')", 19: "''", 49: "NULL", 50: "concat({body}, ' ')", 51: "concat({body}, '\u221a\u00a9')"}, "id": {20: "'a b'", 21: "NULL", 39: "'same'"}, "source": {22: "''", 23: "'src 1'"}, "origin_source": {24: "'x y'", 40: "'nowhere'"},
    "license_status": {25: "' '"}, "prompt_version": {26: "''"}, "release_version": {27: "' '"}, "verified_at": {28: "'2026-1-1'"}, "standard_version": {29: "'v1'", 30: "NULL"}, "standard_rules": {31: "'Bad Rule'"},
    "quality_score": {32: "1.5"}, "model": {6: "NULL", 7: "'m'"}, "provider_derived": {6: "true", 41: "true"}, "review_status": {33: "'FINE'", 34: "'UNREVIEWED'", 35: "'HUMAN_APPROVED'", 36: "'REJECTED'", 42: "'READY_FOR_APPROVAL'", 43: "'HUMAN_APPROVED'", 44: "'HUMAN_APPROVED'"},
    "reviewers": {42: "'E01,e2'", 43: "'E01,L01'", 44: "'E01'", 45: "''", 46: "'X99'"}, "approver": {34: "'L01'", 42: "'L01'", 43: "'L01'", 44: "'O01'", 47: "'someone'"}, "approval": {44: "'owner_sole'", 48: "'other'"},
}
_DEFAULTS = {
    "format_version": "'1.0'", "kind": "'sentence_pair'", "tier": "'silver'", "split": "'excluded'", "origin": "'human'", "source_text": "{body}", "target_text": "{body}", "standard_text": "{body}", "id": "concat('d', CAST(doc_id AS {s}))",
    "source": "source", "origin_source": "NULL", "license_status": "NULL", "prompt_version": "NULL", "release_version": "NULL", "verified_at": "NULL", "standard_version": "'1.0.0'", "standard_rules": "''", "quality_score": "0.5", "model": "NULL",
    "provider_derived": "NULL", "review_status": "'NEEDS_CORRECTION'", "reviewers": "'E01'", "approver": "NULL", "approval": "NULL",
}
_NUMBERS = {"quality_score": "DOUBLE", "provider_derived": "BOOLEAN"}


def _field(name: str, string: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in _FAULTS.get(name, {}).items())
    whole = f"CASE doc_id % 61 {cases} ELSE {_DEFAULTS[name]} END" if cases else _DEFAULTS[name]
    return f"CAST({whole.format(body='trim(substr(text, 1, 60))', s=string)} AS {_NUMBERS.get(name, string)})"


_RECORDS_SQL = f"records AS (SELECT doc_id AS line, {', '.join(f'{_field(c, "VARCHAR")} AS {c}' for c in _DEFAULTS)} FROM documents)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records in the corpus's format; a document in 61 has each of the faults."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("line"), *[F.expr(_field(c, "STRING")).alias(c) for c in _DEFAULTS])


@query(f"WITH {_RECORDS_SQL}, f AS (SELECT unnest({rules_sql()}) AS fault FROM records) SELECT fault, count(*) AS records FROM f GROUP BY fault")
def conformance_faults(spark: SparkSession, sf: str) -> DataFrame:
    """How many records break each rule."""
    return record_faults(records(spark, sf)).groupBy("fault").agg(F.count("*").alias("records"))


_ROSTER = (("E01", "reviewer"), ("E02", "reviewer"), ("L01", "lead_editor"), ("O01", "owner"))
_ROSTER_SQL = "roster(person, role) AS (VALUES " + ", ".join(str(r) for r in _ROSTER) + ")"


@query(
    f"""WITH {_RECORDS_SQL}, {_ROSTER_SQL}, rights AS (SELECT source, CASE WHEN count(*) % 3 > 0 THEN 'cleared' ELSE 'blocked' END AS training FROM documents WHERE source IS NOT NULL GROUP BY source),
firsts AS (SELECT id, min(line) AS first FROM records WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1),
people AS (SELECT line, unnest(string_split(reviewers, ',')) AS person, 'reviewer' AS role_as FROM records UNION ALL SELECT line, approver, CASE WHEN approval = 'owner_sole' THEN 'sole' ELSE 'approver' END FROM records WHERE approver IS NOT NULL),
cited AS (SELECT line, split, source FROM records WHERE source IS NOT NULL UNION ALL SELECT line, split, origin_source FROM records WHERE origin_source IS NOT NULL)
SELECT line, 'id_repeats' AS fault FROM records JOIN firsts USING (id) WHERE line > first
UNION ALL SELECT DISTINCT line, 'not_in_roster_as_' || role_as FROM people LEFT JOIN roster USING (person) WHERE person <> '' AND NOT coalesce(CASE role_as WHEN 'reviewer' THEN role IN ('reviewer', 'owner') WHEN 'approver' THEN role IN ('lead_editor', 'owner') ELSE role = 'owner' END, false)
UNION ALL SELECT * FROM (SELECT DISTINCT line, CASE WHEN training IS NULL THEN 'source_unknown' WHEN coalesce(split, '') <> 'excluded' AND training <> 'cleared' THEN 'source_not_cleared' END AS fault FROM cited LEFT JOIN rights USING (source)) WHERE fault IS NOT NULL
UNION ALL SELECT line, 'provider_derived_in_training' FROM records WHERE provider_derived AND coalesce(split, '') <> 'excluded'"""
)
def file_conformance(spark: SparkSession, sf: str) -> DataFrame:
    """What only the whole file shows: repeated ids, roles, rights for training."""
    status = F.when(F.count("*") % 3 > 0, "cleared").otherwise("blocked").alias("training")
    rights = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(status)
    return file_faults(records(spark, sf), spark.createDataFrame(list(_ROSTER), "person string, role string"), rights, "training")
