"""Conformance of records: a registry of rules, made into one projection, and what only the whole file shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the fields of a record may hold.
KINDS = ("sentence_pair", "dictionary_sense", "example", "verse")
TIERS = ("gold", "silver", "bronze")
SPLITS = ("train", "validation", "test", "excluded")
ORIGINS = ("human", "machine_generated", "published")
STATUSES = ("UNREVIEWED", "NEEDS_CORRECTION", "READY_FOR_APPROVAL", "HUMAN_APPROVED", "REJECTED")
FORMAT = "1.0"
#: Which role a reviewer and an approver may have.
REVIEWERS, APPROVERS = ("reviewer", "owner"), ("lead_editor", "owner")

_CONTROL = r"[\x00-\x1f\x7f-\x9f\x{{2028}}\x{{2029}}]"
_DAMAGE = r"[\x{{221A}}\x{{2248}}][\x{{00A9}}\x{{2022}}\x{{00B1}}\x{{00BA}}\x{{00B4}}]|\x{{201A}}\x{{00C4}}"


def _one_of(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _absent(c: str) -> str:
    return f"({c} IS NULL OR {c} = '')"


def _text_rules(c: str) -> dict[str, str]:
    return {
        f"{c}_missing": f"{c} IS NULL", f"{c}_empty": f"trim({c}) = ''", f"{c}_outer_spaces": f"trim({c}) <> '' AND {c} <> trim({c})",
        f"{c}_control_character": f"{{match}}({c}, '{_CONTROL}')", f"{c}_damaged": f"{{match}}({c}, '{_DAMAGE}')",
    }


#: Code and condition of every rule of a single record, in SQL that needs only the name of the pattern test.
#: A condition that is null doesn't hold. reviewers and standard_rules are comma separated.
RULES: dict[str, str] = {
    "format_version": f"format_version IS NULL OR format_version <> '{FORMAT}'",
    **{f"{c}_unknown": f"{c} IS NULL OR {c} NOT IN {_one_of(v)}" for c, v in (("kind", KINDS), ("tier", TIERS), ("split", SPLITS), ("origin", ORIGINS))},
    **_text_rules("source_text"), **_text_rules("target_text"), **_text_rules("standard_text"),
    **{f"{c}_malformed": f"{c} IS NULL OR {c} = '' OR {{match}}({c}, '[ \\t\\n\\r]')" for c in ("id", "source")},
    "origin_source_malformed": "origin_source = '' OR {match}(origin_source, '[ \\t\\n\\r]')",
    "license_blank": "trim(license_status) = ''", "prompt_version_blank": "trim(prompt_version) = ''", "release_version_blank": "trim(release_version) = ''",
    "verified_at_malformed": "NOT {match}(verified_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$')",
    "sense_id_malformed": "kind = 'dictionary_sense' AND NOT {match}(id, '^Z[DS]-[0-9]{{6}}$')",
    "standard_version_malformed": "standard_version IS NULL OR NOT {match}(standard_version, '^[0-9]+[.][0-9]+[.][0-9]+$')",
    "standard_rules_malformed": "standard_rules <> '' AND NOT {match}(standard_rules, '^[a-z0-9-]+(,[a-z0-9-]+)*$')",
    "standard_rules_unnamed": f"standard_text <> target_text AND {_absent('standard_rules')}",
    "quality_score_range": "NOT quality_score BETWEEN 0 AND 1",
    "machine_without_model": "origin = 'machine_generated' AND (model IS NULL OR trim(model) = '')",
    "machine_without_provider": "origin = 'machine_generated' AND provider_derived IS NULL",
    "review_status_unknown": f"review_status IS NULL OR review_status NOT IN {_one_of(STATUSES)}",
    "reviewers_malformed": "reviewers <> '' AND NOT {match}(reviewers, '^[A-Z]{{1,3}}[0-9]{{2}}(,[A-Z]{{1,3}}[0-9]{{2}})*$')",
    "approver_malformed": "NOT {match}(approver, '^[A-Z]{{1,3}}[0-9]{{2}}$')",
    "unreviewed_with_people": f"review_status = 'UNREVIEWED' AND (NOT {_absent('reviewers')} OR approver IS NOT NULL)",
    "reviewed_by_nobody": f"review_status <> 'UNREVIEWED' AND {_absent('reviewers')}",
    "approver_too_early": "approver IS NOT NULL AND review_status NOT IN ('HUMAN_APPROVED', 'REJECTED')",
    "approval_unknown": "approval <> 'owner_sole'",
    "approver_is_reviewer": "approver IS NOT NULL AND approval IS NULL AND concat(',', reviewers, ',') LIKE concat('%,', approver, ',%')",
    "sole_without_review": "approval = 'owner_sole' AND (approver IS NULL OR reviewers IS NULL OR NOT concat(',', reviewers, ',') LIKE concat('%,', approver, ',%'))",
    "approved_by_nobody": "review_status = 'HUMAN_APPROVED' AND approver IS NULL",
    "rejected_but_used": "review_status = 'REJECTED' AND (split IS NULL OR split <> 'excluded')",
    "gold_from_machine": "tier = 'gold' AND origin = 'machine_generated' AND (review_status IS NULL OR review_status <> 'HUMAN_APPROVED')",
}


def rules_sql() -> str:
    """The rules as one DuckDB list of codes."""
    cases = (f"CASE WHEN {holds.format(match='regexp_matches')} THEN '{code}' END" for code, holds in RULES.items())
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def record_faults(records: DataFrame, *keys: str) -> DataFrame:
    """The keys and every ``fault`` of each record, by the rules of single records: one projection, no shuffle."""
    cases = [F.when(F.expr(holds.format(match="regexp_like").replace("\\", "\\\\")), code) for code, holds in RULES.items()]
    return records.select(*keys, F.explode(F.array_compact(F.array(*cases))).alias("fault"))


def file_faults(records: DataFrame, roster: DataFrame, rights: DataFrame, purpose: str | None = None) -> DataFrame:
    """line and fault of what one record alone doesn't show.

    ``records`` has line, a unique number; of equal ids the first line is right.
    ``roster``: person, role. ``rights``: source and one column a purpose with
    its status. Sources must be in the register and, for a purpose, cleared for
    it unless the record is excluded; text from an outside provider isn't for
    training.
    """
    first = records.where("id IS NOT NULL").groupBy("id").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = records.select("line", "id").join(first, "id").where("line > first").select("line", F.lit("id_repeats").alias("fault"))
    people = records.select("line", F.explode(F.split("reviewers", ",")).alias("person"), F.lit("reviewer").alias("as")).where("person <> ''").unionByName(
        records.where("approver IS NOT NULL").select("line", F.col("approver").alias("person"), F.when(F.col("approval") == "owner_sole", "sole").otherwise("approver").alias("as"))
    )
    roles = people.join(roster, "person", "left")
    allowed = F.when(F.col("as") == "reviewer", F.col("role").isin(*REVIEWERS)).when(F.col("as") == "approver", F.col("role").isin(*APPROVERS)).otherwise(F.col("role") == "owner")
    wrong = roles.where(~F.coalesce(allowed, F.lit(False))).select("line", F.concat(F.lit("not_in_roster_as_"), "as").alias("fault")).distinct()
    cited = records.select("line", "split", F.explode(F.array_compact(F.array("source", "origin_source"))).alias("source"))
    known = cited.join(rights.withColumn("there", F.lit(True)), "source", "left")
    status = F.coalesce(F.col(purpose), F.lit("")) if purpose else F.lit("cleared")
    uncleared = (F.coalesce("split", F.lit("")) != "excluded") & (status != "cleared")
    fault = F.when(F.col("there").isNull(), "source_unknown").when(uncleared, "source_not_cleared")
    barred = known.select("line", fault.alias("fault")).where("fault IS NOT NULL").distinct()
    found = repeats.unionByName(wrong).unionByName(barred)
    if purpose == "training":
        derived = records.where("provider_derived AND coalesce(split, '') <> 'excluded'").select("line", F.lit("provider_derived_in_training").alias("fault"))
        found = found.unionByName(derived)
    return found
