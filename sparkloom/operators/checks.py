"""Checks of records before release, of review records, of evaluation items, and what decisions lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text

SPLITS = ("train", "validation", "test")
APPROVED, OWNER_SOLE = "HUMAN_APPROVED", "owner_sole"
ROSTER_CODE = "^[A-Z][0-9]{2,3}$"


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def person(c: str) -> Column:
    """Codes compare without case or outer spaces."""
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def codes(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*[F.when(holds, name) for holds, name in rules]))


def gate_codes(records: DataFrame, owner: str | None = None) -> DataFrame:
    """(pos, code): why a record can't be released, in the order of ``pos``.

    Columns: pos, id, source, target, split, review_status, contributor,
    reviewer, approver, approval, approval_version, source_id, may_train,
    origin, family. What was seen before is found by the least ``pos`` of each
    key: one aggregation a key, whose rows join back, so texts stay where they
    are and a hot key is one row.
    """
    valid = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    both = ~blank("source") & ~blank("target")
    side = lambda c: F.sha1(F.lower(normalize_text(F.col(c))))
    # The owner alone may write, review and approve, and only where the record says so.
    named = ~(blank("contributor") | blank("reviewer") | blank("approver"))
    sole = F.coalesce(F.col("approval") == OWNER_SOLE, F.lit(False))
    is_owner = (person("approver") == (owner or "").lower()) & (person("reviewer") == (owner or "").lower()) if owner else F.lit(False)
    own = (person("contributor") == person("reviewer")) | (person("contributor") == person("approver"))
    row_codes = codes(
        (blank("id"), "missing_id"), (blank("source"), "missing_source"), (blank("target"), "missing_target"), (~valid, "invalid_split"),
        (~F.coalesce(F.col("review_status") == APPROVED, F.lit(False)), "not_human_approved"),
        (~named, "missing_review_identity"), (named & sole & ~is_owner, "owner_sole_not_owner"), (named & ~sole & own, "self_approval"),
        (named & ~sole & ~own & (person("reviewer") == person("approver")), "reviewer_is_approver"),
        (blank("approval_version"), "missing_approval_version"), (blank("source_id"), "missing_provenance"),
        (~F.coalesce("may_train", F.lit(False)), "training_rights_not_cleared"),
        (~F.coalesce(F.col("origin").isin("en", "ctd"), F.lit(False)), "invalid_origin_language"),
        (valid & blank("family"), "missing_split_family_id"),
    )
    narrow = records.select(
        "pos", F.when(~blank("id"), F.col("id")).alias("id"), F.when(valid, F.col("split")).alias("split"), row_codes.alias("codes"),
        F.when(valid & ~blank("family"), F.col("family")).alias("family"),
        F.when(valid & both, side("source")).alias("s"), F.when(valid & both, side("target")).alias("t"),
    ).withColumn("pair", F.when(F.col("s").isNotNull(), F.sha1(F.concat("s", "t"))))

    def first(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias(f"{key}_pos"), F.min_by("split", "pos").alias(f"{key}_split"))

    met = narrow.join(first(narrow, "id"), "id", "left").join(first(narrow, "family"), "family", "left").join(first(narrow, "pair"), "pair", "left")
    new_pair = F.col("pos") == F.col("pair_pos")
    new = met.where(new_pair)
    met = met.join(first(new, "s"), "s", "left").join(first(new, "t"), "t", "left")
    again = F.col("pos") > F.col("pair_pos")
    other = lambda key: F.col(f"{key}_split") != F.col("split")
    more = codes(
        (F.col("pos") > F.col("id_pos"), "duplicate_id"), (other("family"), "split_family_leakage"),
        (again & ~other("pair"), "duplicate_pair"), (again & other("pair"), "duplicate_pair_across_splits"),
        (new_pair & other("s"), "source_across_splits"), (new_pair & other("t"), "target_across_splits"),
    )
    return met.select("pos", F.explode(F.concat("codes", more)).alias("code"))


def review_record_errors(records: DataFrame) -> Column:
    """What is wrong with a review or approval record; a missing field or unknown kind alone is told."""
    kind = F.col("kind")
    review, approval = kind == "review", kind == "approval"
    absent = codes(
        (blank("pair_hash"), "missing pair_hash"),
        (review & F.col("meaning").isNull(), "missing meaning"), (review & F.col("fluency").isNull(), "missing fluency"),
        (review & blank("reviewer"), "missing reviewer"),
        (approval & blank("decision"), "missing decision"), (approval & blank("approver"), "missing approver"),
    )
    wrong = codes(
        (~F.col("pair_hash").rlike("^[0-9a-f]{40}$"), "malformed pair_hash"),
        (review & ~(F.col("meaning").between(0, 2) & F.col("fluency").between(0, 2)), "score out of range"),
        (review & ~F.col("reviewer").rlike(ROSTER_CODE), "reviewer is no roster code"),
        (approval & ~F.col("decision").isin("approve", "reject"), "unknown decision"),
        (approval & ~F.col("approver").rlike(ROSTER_CODE), "approver is no roster code"),
        (approval & F.col("approval").isNotNull() & (F.col("approval") != OWNER_SOLE), "unknown approval"),
    )
    known = F.coalesce(review | approval, F.lit(False))
    return F.when(~known, F.array(F.lit("unknown kind"))).when(F.size(absent) > 0, absent).otherwise(wrong)


def decide_senses(log: DataFrame, min_reviewers: int = 1) -> DataFrame:
    """sense, status, reviewers, approver, corrections, sole: the fold of a dictionary's review log.

    Columns: position, sense, kind, reviewer, choice (correct, fix, not_here,
    wrong), correction, decision, approval. Of each reviewer the latest review
    counts; the latest approval counts if no review is newer and its author
    reviewed nothing, or approves alone as the owner.
    """
    reviews = log.where("kind = 'review'").groupBy("sense", "reviewer").agg(F.max(F.struct("position", "choice", "correction")).alias("r"))
    folded = reviews.groupBy("sense").agg(
        F.max("r.position").alias("newest"), F.array_sort(F.collect_set("reviewer")).alias("names"),
        F.bool_and(F.col("r.choice") == "correct").alias("all_correct"), F.bool_or(F.col("r.choice").isin("not_here", "wrong")).alias("wrong"),
        F.count_if(F.col("r.choice") == "fix").alias("corrections"),
    )
    last = log.where("kind = 'approval'").groupBy("sense").agg(F.max(F.struct("position", "reviewer", "decision", "approval")).alias("a"))
    j = folded.join(last, "sense", "left")
    sole = F.coalesce(F.col("a.approval") == OWNER_SOLE, F.lit(False))
    inside = F.array_contains("names", F.col("a.reviewer"))
    counts = F.coalesce((F.col("a.position") >= F.col("newest")) & (~inside | sole), F.lit(False))
    ready = (F.size("names") >= min_reviewers) & F.col("all_correct")
    status = (
        F.when(F.col("wrong") | (counts & (F.col("a.decision") == "reject")), "REJECTED")
        .when(ready & counts, APPROVED).when(ready, "READY_FOR_APPROVAL").otherwise("NEEDS_CORRECTION")
    )
    return j.select(
        "sense", status.alias("status"), F.array_join("names", ",").alias("reviewers"), F.when(counts, F.col("a.reviewer")).alias("approver"),
        "corrections", (counts & sole & inside).alias("sole"),
    )


#: What an accepted finding of a category turns into; the others need a value first.
OPERATIONS = {"duplicate_headword": "merge_entries", "variant": "standardize", "not_standard_form": "standardize", "inflected_form": "mark_inflected"}


def plan_changes(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """finding, op, reason: what the latest decision on each finding leads to, where it is an acceptance not yet applied.

    ``findings``: finding, category, digest; ``decisions``: position, finding,
    decision, digest, applied. A finding that is gone or has changed, or a
    category without an operation, needs input, with the reason.
    """
    last = decisions.groupBy("finding").agg(F.max(F.struct("position", "decision", F.col("digest").alias("seen"), "applied")).alias("d"))
    accepted = last.where("d.decision = 'accept' AND NOT d.applied").select("finding", "d.seen")
    j = accepted.join(findings, "finding", "left")
    op = F.coalesce(*[F.when(F.col("category") == c, F.lit(o)) for c, o in OPERATIONS.items()])
    same = F.coalesce(F.col("digest") == F.col("seen"), F.lit(False))
    reason = F.when(~same, "changed").when(op.isNull(), F.concat("category", F.lit(" needs a value")))
    return j.select("finding", F.when(reason.isNull(), op).otherwise("needs_input").alias("op"), reason.alias("reason"))


def owner_outcomes(reviews: DataFrame) -> DataFrame:
    """pair, outcome: the owner's own reviews as decisions in the same pass; ``reviews``: pair, meaning, fluency, correction."""
    fixed = F.trim(F.coalesce("correction", F.lit(""))) != ""
    outcome = (
        F.when(fixed & (F.col("meaning") == 0), "error_correction_of_a_rejection").when(fixed, "edit_and_approve")
        .when((F.col("meaning") == 2) & (F.col("fluency") >= 1), "approve").when(F.col("meaning") == 0, "reject").otherwise("needs_recheck")
    )
    return reviews.select("pair", outcome.alias("outcome"))


def notice_flags(notice: Column) -> Column:
    """Flags of a notice's bracketed tags as slugs; all working references are one."""
    tags = F.regexp_extract_all(F.coalesce(notice, F.lit("")), F.lit(r"\[([^\]]+)\]"), F.lit(1))
    slug = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.transform(tags, lambda x: F.when(slug(x).startswith("working_reference"), "working_reference").otherwise(slug(x)))
