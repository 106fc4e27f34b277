"""Rights of sources by use: valid decisions, and clearance of everything a source is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed
from .records import problems

# States, the paths of a clearance and the evidence each takes, and licences with what they ask for.
STATES = ("cleared", "needs_review", "blocked", "not_permitted")
EVIDENCE = {
    "owner_original": ("owner_authorship",),
    "open_license": ("open_license", "public_domain", "cc0_declaration", "written_permission"),
    "restricted": ("owner_authorship", "open_license", "public_domain", "cc0_declaration", "written_permission", "publisher_permission", "owner_report"),
}
SUPPORTING = ("publisher_permission", "open_license", "cc0_declaration", "written_permission")
CONFIRMED_ELSEWHERE = ("owner_report", "publisher_permission")
ATTRIBUTION_LICENSES = ("CC-BY-2.0-FR", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MIT")
FREE_LICENSES = ("public-domain", "CC0-1.0")
NOT_COMMERCIAL = ("CC-BY-NC-4.0",)
PERSON, OWNER, DATE = r"^[A-Z]{1,3}\d{2}$", r"^O\d{2}$", r"^\d{4}-\d{2}-\d{2}$"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _not(c: Column) -> Column:
    """Not known to hold."""
    return ~F.coalesce(c, F.lit(False))


def decision_errors(has_components: Column) -> Column:
    """Codes of everything that keeps a ``cleared`` entry from being a valid decision, in order.

    The row holds the entry (use, path, evidence, evidence_type, decided_on,
    decided_by, verified_by, underlying_rights_checked, license, attribution,
    grant_scope, provider_terms) and its source (origin, attested_on,
    attribution_required, provider_derived, disputed).
    """
    path, kind, use = F.col("path"), F.col("evidence_type"), F.col("use")
    takes = F.create_map(*[x for p, kinds in EVIDENCE.items() for x in (F.lit(p), F.array(*map(F.lit, kinds)))])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    escalated = flag("provider_derived") | flag("disputed") | has_components | F.coalesce(kind.isin(*CONFIRMED_ELSEWHERE), F.lit(False))
    own = F.coalesce(F.col("origin") == "owner_original", F.lit(False))
    open_to = (path == "restricted") | (~escalated & F.when(own, path == "owner_original").otherwise(path == "open_license"))
    independent = F.exists(F.coalesce("verified_by", F.array().cast("array<string>")), lambda v: v != F.col("decided_by"))
    written = kind == "written_permission"
    known = F.col("license").isin(*ATTRIBUTION_LICENSES, *FREE_LICENSES)
    barred = F.col("license").isin(*NOT_COMMERCIAL) & use.isin("commercial_inference", "redistribute")
    rules = {
        "no_evidence": _blank("evidence"),
        "evidence_type": _not(F.array_contains(F.try_element_at(takes, path), kind)),
        "decided_on": _not(F.col("decided_on").rlike(DATE)),
        "decided_by": _not(F.col("decided_by").rlike(PERSON)),
        "verified_by": F.exists(F.coalesce("verified_by", F.array().cast("array<string>")), lambda v: v.isNull() | ~v.rlike(PERSON)),
        "path_not_open": _not(open_to),
        "no_independent_verifier": (path == "restricted") & _not(independent),
        "underlying_rights": ((path == "open_license") | ((path == "restricted") & kind.isin(*SUPPORTING))) & ~flag("underlying_rights_checked"),
        "owner_decides": (path == "owner_original") & (_not(F.col("decided_by").rlike(OWNER)) | _not(F.col("attested_on").rlike(DATE))),
        "before_provenance": (path == "owner_original") & F.coalesce(F.col("decided_on") < F.col("attested_on"), F.lit(False)),
        "license_unknown": (path == "open_license") & ~written & _not(known),
        "license_use": (path == "open_license") & ~written & F.coalesce(barred, F.lit(False)),
        "grant_scope": (path == "open_license") & written & _not(F.array_contains("grant_scope", use)),
        "attribution": _blank("attribution") & (flag("attribution_required") | ((path == "open_license") & ~written & F.coalesce(F.col("license").isin(*ATTRIBUTION_LICENSES), F.lit(False)))),
        "provider_terms": flag("provider_derived") & _blank("provider_terms"),
    }
    # A clearance without a known path says nothing else.
    return F.when(_not(path.isin(*EVIDENCE)), F.array(F.lit("path"))).otherwise(problems(rules))


def own_status(sources: DataFrame, uses: DataFrame, entries: DataFrame, components: DataFrame) -> DataFrame:
    """source, use, status, basis and errors for every source and use, without regard to what the source is made of.

    An explicit entry of the use decides, else the source's older column
    (``legacy``, a map by use), else the source needs review. Of several
    entries of one use none is valid.
    """
    parts = components.select("source").distinct().withColumn("combined", F.lit(True))
    only = entries.withColumn("_n", F.count("*").over(Window.partitionBy("source", "use")))
    rows = sources.crossJoin(F.broadcast(uses)).join(only.withColumnRenamed("status", "explicit"), ["source", "use"], "left").join(parts, "source", "left")
    rows = rows.dropDuplicates(["source", "use"])
    older = F.try_element_at("legacy", F.col("use"))
    status = F.when(F.col("_n").isNotNull(), F.col("explicit")).otherwise(F.coalesce(older, F.lit("needs_review")))
    basis = F.when(F.col("_n").isNotNull(), "source").when(older.isNotNull(), "legacy").otherwise("none")
    wrong = F.when(_not(F.col("status").isin(*STATES)), F.array(F.lit("status"))).when((F.col("basis") == "source") & (F.col("_n") > 1), F.array(F.lit("two_entries")))
    errors = wrong.when((F.col("basis") == "source") & (F.col("status") == "cleared"), decision_errors(F.coalesce("combined", F.lit(False))))
    made = rows.withColumn("status", status).withColumn("basis", basis)
    return made.select("source", "use", "status", "basis", F.coalesce(errors, F.array().cast("array<string>")).alias("errors"))


def authorized(own: DataFrame, components: DataFrame) -> DataFrame:
    """source, use, allowed, status and reason: cleared, validly, and so is all it is made of, however deep.

    ``own`` is from ``own_status``. Decisions spread from sources without
    components to what they are part of, a step for each level: one refused
    component refuses, the last cleared one clears. What is never reached is
    made of itself. A component that isn't in the register refuses.
    """
    own = checkpointed(own.withColumn("ok", (F.col("status") == "cleared") & (F.size("errors") == 0)))
    edges = components.distinct()
    edges = checkpointed(own.where("ok").select("source", "use").join(edges, "source"))
    counted = edges.groupBy("source", "use").agg(F.count("*").alias("pending"))
    nodes = own.where("ok").select("source", "use").join(counted, ["source", "use"], "left")
    waiting = checkpointed(nodes.where("pending IS NOT NULL"))
    front = own.where("NOT ok").select("source", "use", F.lit(False).alias("good")).unionByName(nodes.where("pending IS NULL").select("source", "use", F.lit(True).alias("good")))
    unknown = edges.join(own.select(F.col("source").alias("component"), "use"), ["component", "use"], "left_anti").select(F.col("component").alias("source"), "use", F.lit(False).alias("good"))
    front = checkpointed(front.unionByName(unknown.distinct()))
    settled = []
    while not front.isEmpty():
        reached = edges.join(front.withColumnRenamed("source", "component"), ["component", "use"]).groupBy("source", "use").agg(F.count_if("good").alias("cleared"), F.bool_or(~F.col("good")).alias("refused"))
        moved = checkpointed(
            waiting.join(reached, ["source", "use"], "left").select("source", "use", (F.col("pending") - F.coalesce("cleared", F.lit(0))).alias("pending"), F.coalesce("refused", F.lit(False)).alias("refused"))
        )
        front = checkpointed(moved.where("refused OR pending = 0").select("source", "use", (~F.col("refused")).alias("good")))
        waiting = moved.where("NOT refused AND pending > 0").select("source", "use", "pending")
        settled.append(front)
    verdicts = waiting.select("source", "use", F.lit("circular_components").alias("held"))
    for rows in settled:
        verdicts = verdicts.unionByName(rows.where("NOT good").select("source", "use", F.lit("component_not_cleared").alias("held")))
    judged = own.join(verdicts, ["source", "use"], "left")
    allowed = F.col("ok") & F.col("held").isNull()
    status = F.when(allowed, "cleared").when((F.col("status") == "cleared") | (F.size("errors") > 0), "needs_review").otherwise(F.col("status"))
    reason = F.when(F.col("ok"), F.coalesce("held", F.lit(""))).when(F.size("errors") > 0, F.get("errors", F.lit(0))).otherwise(F.col("status"))
    return judged.select("source", "use", allowed.alias("allowed"), status.alias("status"), reason.alias("reason"), "basis")


def register_problems(own: DataFrame, decided: DataFrame, sources: DataFrame, components: DataFrame) -> DataFrame:
    """source, use (null where none is meant) and problem: everything that makes a register inconsistent.

    Invalid entries, clearances that differ from the source's older column, clearances before those of the components, components that aren't there.
    """
    entries = own.where("basis = 'source'").select("source", "use", "status", F.explode("errors").alias("problem"))
    older = own.where("basis = 'source' AND status = 'cleared'").join(sources.select("source", "legacy"), "source")
    differs = older.where(F.try_element_at("legacy", F.col("use")) != "cleared").select("source", "use", F.lit("older_column_differs").alias("problem"))
    early = decided.where("basis = 'source' AND reason IN ('component_not_cleared', 'circular_components')").select("source", "use", F.lit("cleared_before_components").alias("problem"))
    gone = components.distinct().join(sources.select(F.col("source").alias("component")), "component", "left_anti")
    missing = gone.groupBy("source").agg(F.lit(None).cast("string").alias("use"), F.lit("unknown_component").alias("problem"))
    return entries.drop("status").unionByName(differs).unionByName(early).unionByName(missing)
