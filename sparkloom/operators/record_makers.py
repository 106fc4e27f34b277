"""Records made from decisions and filled-in sheets: operations, approvals, revisions, draft items. What can't be made says why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changesets import same_text
from .folds import READY

OWNER_SOLE = "owner_sole"


def _payload(**fields: Column) -> Column:
    """Fields as ``name=value`` lines, null ones left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in fields.items()]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _list(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def changeset_operations(findings: DataFrame, decisions: DataFrame, proposals: DataFrame, proposal_decisions: DataFrame, applied: DataFrame) -> DataFrame:
    """decision, op, origin, provider_derived and payload of every accepted decision not yet applied; ``needs_input`` ops say why.

    ``findings``: finding, category, digest, entries, senses, source, headword,
    base_headword. ``decisions``: finding, recorded_at, decision, digest; the
    latest of a finding counts, and only while the finding has its digest.
    ``proposals``: proposal, kind, origin, target_sense, written (its text) and
    standard_form. ``proposal_decisions``: proposal, recorded_at, decision,
    edited_text. ``applied`` has decision: what earlier changesets hold.
    """
    last = decisions.groupBy("finding").agg(F.max(F.struct("recorded_at", "decision", "digest")).alias("d"))
    ref = F.concat_ws(":", F.lit("headword"), F.col("finding").cast("string"), F.col("d.recorded_at").cast("string"))
    found = last.where("d.decision = 'accept'").select(ref.alias("decision"), "finding", F.col("d.digest").alias("seen")).join(applied, "decision", "left_anti").join(findings, "finding", "left")
    same = F.coalesce(F.col("digest") == F.col("seen"), F.lit(False))
    kind = F.col("category")
    entries = F.col("entries")
    senses = F.when(same & kind.isin("variant", "not_standard_form"), F.col("senses").cast("array<string>")).otherwise(F.array(F.lit(None).cast("string")))
    each = found.withColumn("sense", F.explode_outer(senses))
    op = (
        F.when(~same, "needs_input").when(kind == "duplicate_headword", "merge_entries").when(kind.isin("variant", "not_standard_form"), "standardize")
        .when(kind == "inflected_form", "mark_inflected").otherwise("needs_input")
    )
    payload = (
        F.when(~same, _payload(reason=F.lit("the finding is gone or has changed")))
        .when(op == "merge_entries", _payload(keep=F.get(entries, F.lit(0)), remove=_list(F.slice(entries, 2, 1 << 30))))
        .when(op == "standardize", _payload(sense=F.col("sense")))
        .when(op == "mark_inflected", _payload(source=F.col("source"), headword=F.col("headword"), base_headword=F.col("base_headword")))
        .otherwise(_payload(reason=F.concat(kind, F.lit(" needs a value"))))
    )
    made = each.select("decision", op.alias("op"), F.lit("deterministic").alias("origin"), F.lit(False).alias("provider_derived"), payload.alias("payload"))

    last = proposal_decisions.groupBy("proposal").agg(F.max(F.struct("recorded_at", "decision", "edited_text")).alias("d"))
    ref = F.concat_ws(":", F.lit("proposal"), F.col("proposal").cast("string"), F.col("d.recorded_at").cast("string"))
    taken = last.where("d.decision IN ('accept', 'edit')").select(ref.alias("decision"), "proposal", F.when(F.col("d.decision") == "edit", F.coalesce("d.edited_text", F.lit(""))).otherwise("").alias("own"))
    known = taken.join(applied, "decision", "left_anti").join(proposals.withColumn("there", F.lit(True)), "proposal", "left")
    kind, own = F.col("kind"), F.col("own")
    op = (
        F.when(F.col("there").isNull(), "needs_input").when(kind.isin("headword_candidate", "alternative_form"), "add_headword").when(F.col("target_sense").isNull(), "needs_input")
        .when(kind.isin("definition", "equivalent") & ((own != "") | (F.col("origin") == "deterministic")), "set_definition").otherwise("annotate_sense")
    )
    text = F.when(own != "", own).otherwise(F.coalesce("written", F.lit("")))
    payload = (
        F.when(F.col("there").isNull(), _payload(reason=F.lit("the proposal isn't there")))
        .when(op == "add_headword", _payload(word=F.coalesce("written", F.lit("")), meaning=own, variant_of=F.coalesce("standard_form", F.lit(""))))
        .when(op == "needs_input", _payload(reason=F.concat(kind, F.lit(" has no sense to attach to"))))
        .when(op == "set_definition", _payload(sense=F.col("target_sense"), text=text))
        .otherwise(_payload(sense=F.col("target_sense"), kind=kind, value=text))
    )
    offered = known.select("decision", op.alias("op"), F.coalesce("origin", F.lit("")).alias("origin"), (F.coalesce("origin", F.lit("")) == "provider_assisted").alias("provider_derived"), payload.alias("payload"))
    return made.unionByName(offered)


def changeset_id(operations: DataFrame) -> DataFrame:
    """One row: changeset_id and operations, from what the operations say, in whatever order they come."""
    ops = operations.where("op <> 'needs_input'")
    line = F.sha1(F.concat_ws("\n", "decision", "op", "origin", F.col("provider_derived").cast("string"), "payload"))
    total = F.coalesce(F.sum(F.conv(F.left(line, F.lit(12)), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    summed = ops.agg(total.alias("total"), F.count("*").alias("operations"))
    return summed.select(F.concat(F.lit("C-"), F.left(F.sha1(F.concat_ws(":", F.col("total").cast("string"), F.col("operations").cast("string"))), F.lit(12))).alias("changeset_id"), "operations")


def approvals(sheet: DataFrame, statuses: DataFrame, approver: str, role: str | None) -> DataFrame:
    """item, pair, decision, approval and error of every row of an approval sheet that is filled in.

    ``sheet``: item, pair, decision, digest (of the text as given back) and
    sheet_digest; ``statuses``: pair, status, reviewers (comma separated). The
    approver must be a lead editor or the owner in the roster. A record has no
    error; ``approval`` marks the owner's approval of their own review.
    """
    filled = sheet.withColumn("decision", F.lower(F.trim(F.coalesce("decision", F.lit(""))))).where("decision <> ''")
    j = filled.join(statuses.select("pair", "status", "reviewers"), "pair", "left")
    inside = F.array_contains(F.split(F.coalesce("reviewers", F.lit("")), ","), approver)
    owner = F.lit(role == "owner")
    error = (
        F.when(F.lit(role not in ("lead_editor", "owner")), "not_a_lead_editor").when(~F.col("decision").isin("approve", "reject"), "unknown_decision")
        .when(~F.coalesce(F.col("digest") == F.col("sheet_digest"), F.lit(False)), "text_differs")
        .when(~F.coalesce(F.col("status") == READY, F.lit(False)), F.concat(F.lit("not_ready:"), F.coalesce("status", F.lit("not reviewed"))))
        .when(inside & ~owner, "reviewed_it_too")
    )
    return j.select("item", "pair", "decision", F.when(error.isNull() & inside, OWNER_SOLE).alias("approval"), error.alias("error"))


def owner_records(reviews: DataFrame) -> DataFrame:
    """pair, kind, decision, before, after and error: the owner's own reviews as records of the same pass.

    ``reviews``: pair, meaning, fluency, correction, shown (the text they saw).
    A correction makes a revision, unless the meaning rejects the pair or the
    text stays the same; an acceptable pair is approved; nothing else makes a record.
    """
    fix = F.trim(F.regexp_replace(F.coalesce("correction", F.lit("")), r"\s+", " "))
    shown = F.trim(F.regexp_replace(F.coalesce("shown", F.lit("")), r"\s+", " "))
    fixed, ok = fix != "", (F.col("meaning") == 2) & (F.col("fluency") >= 1)
    error = F.when(fixed & (F.col("meaning") == 0), "meaning_rejects").when(fixed & same_text(fix, shown), "nothing_changes").when(fixed & (shown == ""), "text_unknown")
    kind = F.when(fixed, "revision").when(ok, "approval")
    return reviews.where(fixed | ok).select(
        "pair", kind.alias("kind"), F.when(~fixed, "approve").alias("decision"), F.when(fixed, shown).alias("before"), F.when(fixed, fix).alias("after"), error.alias("error")
    )


def draft_items(sheet: DataFrame, topics: tuple[str, ...], direction: str, translator: str, origin: str) -> DataFrame:
    """Rows of a translation sheet as draft items with an ``outcome``: pending, blank (not yet translated), or unknown_topic, which refuses the sheet.

    ``sheet``: id, topic, source_text, translation, notes.
    """
    blank = F.trim(F.coalesce("translation", F.lit(""))) == ""
    outcome = F.when(blank, "blank").when(~F.coalesce(F.col("topic").isin(*topics), F.lit(False)), "unknown_topic").otherwise("pending")
    return sheet.select(
        "id", F.lit(direction).alias("direction"), F.col("topic").alias("domain"), "source_text", F.when(~blank, F.array("translation")).alias("references"),
        F.lit(origin).alias("source_origin"), F.lit(translator).alias("translator"), outcome.alias("outcome"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
