"""Review logs: decisions, their application, approvals, samples and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as t
from ..operators.dedup import nth_identical
from ..operators.folds import decide, latest, wilson
from ..operators.lineage import checkpointed
from ..operators.numbering import numbered
from ..sources.views import SQL, decision_log, line_pairs, table
from .registry import query


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return decision_log(table(spark, sf, "events"))


_DECIDE_SQL = f"""{SQL["decision_log"]},
rv AS (SELECT * FROM decision_log WHERE kind = 'review' QUALIFY row_number() OVER (PARTITION BY pair, reviewer ORDER BY position DESC) = 1),
fold AS (SELECT pair, max(position) AS newest, list_sort(list(reviewer)) AS names, bool_and(meaning = 2 AND fluency >= 1) AS acceptable, bool_or(meaning = 0) AS wrong FROM rv GROUP BY pair),
ap AS (SELECT * FROM decision_log WHERE kind = 'approval' QUALIFY row_number() OVER (PARTITION BY pair ORDER BY position DESC) = 1),
j AS (SELECT fold.*, ap.decision, ap.reviewer AS approver, coalesce(ap.position > newest AND NOT list_contains(names, ap.reviewer), false) AS counts FROM fold LEFT JOIN ap USING (pair)),
decided AS (SELECT pair, CASE WHEN wrong OR (counts AND decision = 'reject') THEN 'REJECTED' WHEN acceptable AND counts THEN 'HUMAN_APPROVED'
   WHEN acceptable THEN 'READY_FOR_APPROVAL' ELSE 'NEEDS_CORRECTION' END AS status, array_to_string(names, ',') AS reviewers, CASE WHEN counts THEN approver END AS approver FROM j)"""


@query(f"WITH {_DECIDE_SQL} SELECT * FROM decided")
def decision_status(spark: SparkSession, sf: str) -> DataFrame:
    return decide(_log(spark, sf))


@query(f"WITH {_DECIDE_SQL} SELECT pair, reviewer, position, meaning, fluency FROM rv")
def latest_reviews(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).where("kind = 'review'").select("pair", "reviewer", "position", "meaning", "fluency")
    return latest(log, ["pair", "reviewer"])


@query(
    f"""WITH {_DECIDE_SQL}, {SQL["line_pairs"]} SELECT coalesce(status, CASE WHEN d.pair IS NULL THEN 'UNREVIEWED' END) AS status, count(*) AS pairs
FROM line_pairs p LEFT JOIN decided d ON d.pair = p.id % 1000 GROUP BY ALL"""
)
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions joined to the pairs they are about, and how many have none."""
    pairs = line_pairs(table(spark, sf, "documents")).select(F.pmod("id", F.lit(1000)).alias("pair"))
    # Counted by key first, so a hot key joins as one row.
    keyed = pairs.groupBy("pair").agg(F.count("*").alias("n"))
    joined = keyed.join(decide(_log(spark, sf)), "pair", "left")
    return joined.groupBy(F.coalesce("status", F.lit("UNREVIEWED")).alias("status")).agg(F.sum("n").alias("pairs"))


@query(
    f"""WITH {_DECIDE_SQL}, {SQL["line_pairs"]}, k AS (SELECT DISTINCT id % 1000 AS pair FROM line_pairs)
SELECT status, count(*) AS not_in_corpus FROM decided WHERE pair NOT IN (SELECT pair FROM k) GROUP BY status"""
)
def unmatched_decisions(spark: SparkSession, sf: str) -> DataFrame:
    keys = line_pairs(table(spark, sf, "documents")).select(F.pmod("id", F.lit(1000)).alias("pair")).distinct()
    return decide(_log(spark, sf)).join(keys, "pair", "left_anti").groupBy("status").agg(F.count("*").alias("not_in_corpus"))


@query(
    """SELECT event_id, sha1(user_id || '|' || event_type || '|' || (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1)) AS record_id FROM events"""
)
def record_identity(spark: SparkSession, sf: str) -> DataFrame:
    """An id from a record's content and the number of identical earlier ones."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    nth = nth_identical(e, ["user_id", "event_type"], "event_id")
    return e.select("event_id", F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", nth.cast("string"))).alias("record_id"))


@query(
    f"""WITH {SQL["decision_log"]}, l AS (SELECT pair, decision FROM decision_log WHERE kind = 'approval' QUALIFY row_number() OVER (PARTITION BY pair ORDER BY position DESC) = 1)
SELECT pair, decision FROM l WHERE decision <> 'reject'"""
)
def settled_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings whose latest decision settles them."""
    log = _log(spark, sf).where("kind = 'approval'").select("pair", "position", "decision")
    return latest(log, ["pair"]).where("decision <> 'reject'").select("pair", "decision")


@query(
    f"""WITH {SQL["decision_log"]} SELECT pair, min(position) FILTER (decision = 'approve') AS first_applied
FROM decision_log WHERE kind = 'approval' GROUP BY pair HAVING arg_max(decision, position) = 'approve'"""
)
def active_changesets(spark: SparkSession, sf: str) -> DataFrame:
    """Change sets whose last state is applied, with when they were first."""
    log = _log(spark, sf).where("kind = 'approval'")
    folded = log.groupBy("pair").agg(F.min(F.when(F.col("decision") == "approve", F.col("position"))).alias("first_applied"), F.max_by("decision", "position").alias("last"))
    return folded.where("last = 'approve'").select("pair", "first_applied")


@query(
    f"""WITH {SQL["decision_log"]} SELECT coalesce(l.decision, 'open') AS state, count(*) AS findings FROM (SELECT DISTINCT pair FROM decision_log) p
LEFT JOIN (SELECT pair, arg_max(decision, position) AS decision FROM decision_log WHERE kind = 'approval' GROUP BY pair) l USING (pair) GROUP BY ALL"""
)
def finding_states(spark: SparkSession, sf: str) -> DataFrame:
    """Findings open and decided."""
    log = _log(spark, sf)
    last = F.max_by(F.when(F.col("kind") == "approval", F.col("decision")), F.when(F.col("kind") == "approval", F.col("position")))
    return log.groupBy("pair").agg(last.alias("d")).groupBy(F.coalesce("d", F.lit("open")).alias("state")).agg(F.count("*").alias("findings"))


@query(
    f"""WITH {SQL["decision_log"]}, r AS (SELECT pair, arg_max('v' || position, position) AS after, arg_max(reviewer, position) AS proposed_by, count(*) AS proposals
FROM decision_log WHERE kind = 'review' AND meaning < 2 GROUP BY pair), d AS (SELECT DISTINCT pair FROM decision_log WHERE decision = 'reject')
SELECT pair, after, proposed_by, proposals, d.pair IS NOT NULL AS declined FROM r LEFT JOIN d USING (pair)"""
)
def latest_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """The latest proposed text of each pair and whether it was declined."""
    log = _log(spark, sf)
    r = log.where("kind = 'review' AND meaning < 2").groupBy("pair").agg(
        F.max_by(F.concat(F.lit("v"), F.col("position").cast("string")), "position").alias("after"),
        F.max_by("reviewer", "position").alias("proposed_by"), F.count("*").alias("proposals"),
    )
    d = log.where("decision = 'reject'").select("pair").distinct().withColumn("no", F.lit(True))
    return r.join(d, "pair", "left").select("pair", "after", "proposed_by", "proposals", F.col("no").isNotNull().alias("declined"))


@query(
    f"""WITH {SQL["decision_log"]}, stored AS (SELECT position, sha1(pair || kind) AS id FROM decision_log WHERE position < 500),
file AS (SELECT position, sha1(pair || kind) AS id FROM decision_log)
SELECT count(*) FILTER (s.id = f.id) AS same, count(*) FILTER (s.id IS NOT NULL AND s.id <> f.id) AS changed, count(*) FILTER (s.id IS NULL) AS appended FROM file f LEFT JOIN stored s USING (position)"""
)
def append_only_check(spark: SparkSession, sf: str) -> DataFrame:
    """A grown log against its stored prefix, position by position."""
    file = _log(spark, sf).select("position", F.sha1(F.concat(F.col("pair").cast("string"), "kind")).alias("id"))
    stored = file.where("position < 500").withColumnRenamed("id", "was")
    j = file.join(stored, "position", "left")
    return j.agg(
        F.count_if(F.col("was") == F.col("id")).alias("same"), F.count_if(F.col("was") != F.col("id")).alias("changed"), F.count_if(F.col("was").isNull()).alias("appended")
    )


_Z = 1.96


@query(
    """WITH g AS (SELECT source, count(*) AS total, count(l.doc_id) AS rated, avg(quality) AS mean_quality, count(*) FILTER (quality = 1 AND toxic = 0) AS acceptable
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source), p AS (SELECT *, acceptable / rated AS p, rated::DOUBLE AS n FROM g)
SELECT source, total, rated, round(mean_quality, 6) AS mean_quality, acceptable,
  CASE WHEN rated > 0 THEN round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) END AS low,
  CASE WHEN rated > 0 THEN round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) END AS high FROM p"""
)
def generator_wilson(spark: SparkSession, sf: str) -> DataFrame:
    """Share of acceptable documents of each source with its Wilson interval."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    j = d.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    g = j.groupBy("source").agg(
        F.count("*").alias("total"), F.count("quality").alias("rated"), F.avg("quality").alias("mean_quality"),
        F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("acceptable"),
    )
    low, high = wilson(F.col("acceptable"), F.col("rated"), _Z)
    return g.select("source", "total", "rated", F.round("mean_quality", 6).alias("mean_quality"), "acceptable", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_CLUSTER_SQL = f"""{SQL["line_pairs"]},
u AS (SELECT id, {t.sql_template("source_text")} AS template, {t.sql_variant("target_text")} AS target_key,
   round_even(1 - {q.sql_score("flags")} + 0.5 * len(list_filter(flags, lambda f: f IN ('extremely_long', 'extremely_short', 'length_ratio_outlier', 'target_reused'))) + CASE WHEN model = 'm0' THEN 1.0 ELSE 0.0 END, 4) AS uncertainty
   FROM (SELECT *, {q.sql_flags("source_text", "target_text")} AS flags FROM line_pairs)),
c AS (SELECT template, count(*) AS n, count(DISTINCT target_key) AS variants, avg(uncertainty) AS mean_u, arg_min(id, (-uncertainty, id)) AS representative, min(id) AS first_id FROM u GROUP BY template HAVING count(*) > 1),
s AS (SELECT template, n, variants, representative, first_id, round(2 * log2(1 + n) + 3 * (variants - 1) / (n - 1) + mean_u, 4) AS priority FROM c)"""


def queued(pairs: DataFrame) -> DataFrame:
    """id, template, target_key, uncertainty of each pair; generator m0 is the outdated one."""
    flags = q.quality_flags(F.col("source_text"), F.col("target_text"))
    return pairs.withColumn("flags", flags).select(
        "id", t.template_key(F.col("source_text")).alias("template"), t.variant_key(F.col("target_text")).alias("target_key"),
        q.uncertainty(q.quality_score(F.col("flags")), F.col("flags"), F.col("model") == "m0").alias("uncertainty"),
    )


def clusters(rows: DataFrame) -> DataFrame:
    """Template clusters of two rows or more: size, variants, priority, representative, first id."""
    c = rows.groupBy("template").agg(
        F.count("*").alias("n"), F.countDistinct("target_key").alias("variants"), F.avg("uncertainty").alias("mean_u"),
        F.min(F.struct(-F.col("uncertainty"), F.col("id").alias("id"))).alias("rep"), F.min("id").alias("first_id"),
    ).where("n > 1")
    priority = 2 * F.log2(1 + F.col("n")) + 3 * (F.col("variants") - 1) / (F.col("n") - 1) + F.col("mean_u")
    return c.select("template", "n", "variants", F.col("rep.id").alias("representative"), "first_id", F.round(priority, 4).alias("priority"))


@query(f"WITH {_CLUSTER_SQL} SELECT template, n, variants, representative, first_id, priority FROM s")
def template_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(queued(line_pairs(table(spark, sf, "documents"))))


@query(
    f"""WITH {_CLUSTER_SQL}, r AS (SELECT u.id, s.template, s.priority, s.first_id, uncertainty, CASE WHEN s.template IS NULL THEN 1 WHEN row_number() OVER (PARTITION BY s.template ORDER BY u.id <> representative, uncertainty DESC, u.id) <= 10 THEN 0 ELSE 2 END AS phase,
  CASE WHEN s.template IS NOT NULL THEN row_number() OVER (PARTITION BY s.template ORDER BY u.id <> representative, uncertainty DESC, u.id) END AS member FROM u LEFT JOIN s USING (template))
SELECT id, phase, member FROM r ORDER BY phase, CASE WHEN phase <> 1 THEN -priority END, CASE WHEN phase <> 1 THEN first_id END, member, -uncertainty, id LIMIT 500"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 of the review order: clusters by priority, ten of each, then single rows, then the rest."""
    # Written out: the clusters and the order both need them, and the flags are the dear part.
    rows = checkpointed(queued(line_pairs(table(spark, sf, "documents"))))
    j = checkpointed(rows.drop("target_key").join(clusters(rows).drop("n", "variants"), "template", "left"))
    single = j.where("priority IS NULL").select("id", "priority", "first_id", "uncertainty", F.lit(None).cast("long").alias("member"), F.lit(1).alias("phase"))
    clustered = j.where("priority IS NOT NULL").withColumn("at", F.struct((F.col("id") != F.col("representative")).alias("later"), -F.col("uncertainty"), "id"))
    columns = ["id", "priority", "first_id", "uncertainty", "member", "phase"]
    # Ten of each cluster: every task keeps ten before the shuffle.
    nth = F.row_number().over(Window.partitionBy("template").orderBy("at"))
    ten = clustered.withColumn("member", nth.cast("long")).where("member <= 10").withColumn("phase", F.lit(0)).select(*columns)
    shown = ten.unionByName(single.select(*columns))
    if shown.limit(500).count() < 500:
        # What comes after the tenth is numbered by ranges: a cluster may hold any share of all rows.
        rest = numbered(clustered.select(*columns[:4], "template", "at"), "at", "member", within="template")
        shown = shown.unionByName(rest.where("member > 10").withColumn("phase", F.lit(2)).select(*columns))
    in_cluster = F.col("phase") != 1
    return (
        shown.orderBy("phase", F.when(in_cluster, -F.col("priority")).asc_nulls_last(), F.when(in_cluster, F.col("first_id")).asc_nulls_last(), F.col("member").asc_nulls_last(), -F.col("uncertainty"), "id")
        .limit(500)
        .select("id", F.col("phase").cast("int").alias("phase"), "member")
    )


@query(
    """SELECT c_nationkey AS class, c_custkey AS member, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place
FROM customer QUALIFY place <= 25 - (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey)"""
)
def waitlist_promotion(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest waiting of each class, as many as seats are free: 25 less those enrolled."""
    taken = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("taken"))
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey"))
    # No class has more than 25 seats: the window keeps 25 rows of a task before its shuffle.
    ranked = table(spark, sf, "customer").select("c_nationkey", "c_custkey", nth.alias("place")).where("place <= 25")
    j = ranked.join(F.broadcast(taken), "c_nationkey", "left").where(F.col("place") <= 25 - F.coalesce("taken", F.lit(0)))
    return j.select(F.col("c_nationkey").alias("class"), F.col("c_custkey").alias("member"), F.col("place").cast("long").alias("place"))


@query(
    """SELECT user_id, event_type AS last_action, n % 2 = 1 AS bookmarked FROM (SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id)"""
)
def bookmark_state(spark: SparkSession, sf: str) -> DataFrame:
    """Toggles folded to a state, with the last action."""
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.max_by("event_type", "event_id").alias("last_action"), (F.count_if(F.col("event_type") == "click") % 2 == 1).alias("bookmarked")
    )


@query(
    """SELECT user_id, event_type, last_seen, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_seen DESC) AS place FROM (SELECT user_id, event_type, max(event_id) AS last_seen FROM events GROUP BY ALL)) WHERE place <= 3"""
)
def recent_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's three latest distinct actions, newest first."""
    h = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_seen"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_seen")))
    return h.withColumn("place", nth.cast("long")).where("place <= 3")
