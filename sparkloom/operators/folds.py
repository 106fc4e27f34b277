"""Folds over append-only logs: the last record of a key decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REJECTED, APPROVED, READY, CORRECTION = "REJECTED", "HUMAN_APPROVED", "READY_FOR_APPROVAL", "NEEDS_CORRECTION"


def latest(log: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """The record of each key with the greatest position, which is unique; combines before its shuffle."""
    rest = [c for c in log.columns if c not in keys and c != position]
    return log.groupBy(*keys).agg(F.max(F.struct(position, *rest)).alias("_last")).select(*keys, "_last.*")


def decide(log: DataFrame, min_reviewers: int = 1) -> DataFrame:
    """pair, status, reviewers, approver: one status for each reviewed pair.

    Of each reviewer the latest review counts. An approval counts if it is newer
    than every counted review and its author isn't among the reviewers. A
    meaning of 0 or a counted rejection rejects; enough acceptable reviews are
    ready, with an approval approved; else the pair needs correction. A pair
    with approvals alone has no decision.
    """
    reviews = latest(log.where("kind = 'review'").select("pair", "reviewer", "position", "meaning", "fluency"), ["pair", "reviewer"])
    ok = (F.col("meaning") == 2) & (F.col("fluency") >= 1)
    folded = reviews.groupBy("pair").agg(
        F.max("position").alias("newest"),
        F.array_sort(F.collect_set("reviewer")).alias("names"),
        F.bool_and(ok).alias("acceptable"),
        F.bool_or(F.col("meaning") == 0).alias("wrong"),
    )
    approvals = latest(
        log.where("kind = 'approval'").select("pair", "position", F.col("reviewer").alias("approver"), "decision"), ["pair"]
    ).withColumnRenamed("position", "approved_at")
    joined = folded.join(approvals, "pair", "left")
    counts = F.coalesce((F.col("approved_at") > F.col("newest")) & ~F.array_contains("names", F.col("approver")), F.lit(False))
    ready = (F.size("names") >= min_reviewers) & F.col("acceptable")
    status = (
        F.when(F.col("wrong") | (counts & (F.col("decision") == "reject")), REJECTED)
        .when(ready & counts, APPROVED)
        .when(ready, READY)
        .otherwise(CORRECTION)
    )
    return joined.select("pair", status.alias("status"), F.array_join("names", ",").alias("reviewers"), F.when(counts, F.col("approver")).alias("approver"))


def wilson(successes, n, z: float = 1.96):
    """Bounds of the Wilson interval as two columns; null for no trials."""
    p, z2 = successes / n, z * z
    centre, spread = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return tuple(F.when(n > 0, (centre + s * spread) / (1 + z2 / n)) for s in (-1, 1))
