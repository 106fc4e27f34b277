"""Checks before release, review records, dictionary decisions and change planning as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import checks
from ..sources.views import SQL, table, turn_pairs
from .registry import query

OWNER = "r1"


def _case(*pairs: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


#: Release records made of turn pairs, with a fault for every code; the same expressions in Spark and DuckDB.
_RECORD = {
    "pos": "id",
    "id": _case(("id % 97 = 3", "' '"), ("id % 89 = 2", "'r1'"), otherwise="concat('r', CAST(id AS {s}))"),
    "source": _case(("id % 101 = 5", "' '"), ("id % 37 = 1", "'the same question'"), otherwise="source_text"),
    "target": _case(("id % 103 = 5", "NULL"), ("id % 37 = 1", "CASE WHEN id % 2 = 0 THEN 'one' ELSE 'two' END"), ("id % 41 = 1", "'yes'"), otherwise="target_text"),
    "split": _case(("id % 83 = 4", "'dev'"), ("conv_id % 10 = 8", "'validation'"), ("conv_id % 10 = 9", "'test'"), otherwise="'train'"),
    "review_status": _case(("id % 7 = 2", "'READY'"), otherwise="'HUMAN_APPROVED'"),
    "contributor": "concat('c', CAST(conv_id % 5 AS {s}))",
    "reviewer": _case(("id % 31 = 4", "' C1 '"), otherwise="concat('r', CAST(conv_id % 4 AS {s}))"),
    "approver": _case(("id % 43 = 4", "NULL"), ("id % 29 = 4", "'R1'"), otherwise="concat('e', CAST(conv_id % 3 AS {s}))"),
    "approval": _case(("id % 13 = 4", "'owner_sole'"), otherwise="NULL"),
    "approval_version": _case(("id % 47 = 4", "''"), otherwise="'v1'"),
    "source_id": _case(("id % 53 = 4", "NULL"), otherwise="'s'"),
    "may_train": "id % 11 <> 4",
    "origin": _case(("id % 59 = 4", "'my'"), otherwise="'en'"),
    "family": _case(("id % 61 = 4", "' '"), ("id % 17 = 4", "'shared'"), otherwise="concat('f', CAST(conv_id AS {s}))"),
}


def _record_columns(string: str) -> list[str]:
    return [f"{v.format(s=string)} AS {k}" for k, v in _RECORD.items()]


_BLANK = lambda c: f"trim(coalesce({c}, '')) = ''"
_PERSON = lambda c: f"lower(trim(coalesce({c}, '')))"
_OWN = f"({_PERSON('contributor')} = {_PERSON('reviewer')} OR {_PERSON('contributor')} = {_PERSON('approver')})"
_GATE_SQL = f"""{SQL["turn_pairs"]}, rec AS (SELECT {", ".join(_record_columns("VARCHAR"))} FROM turn_pairs),
k AS (SELECT *, coalesce(split IN ('train', 'validation', 'test'), false) AS valid, NOT ({_BLANK("contributor")} OR {_BLANK("reviewer")} OR {_BLANK("approver")}) AS named,
  coalesce(approval = 'owner_sole', false) AS sole, CASE WHEN NOT {_BLANK("id")} THEN id END AS rid,
  CASE WHEN coalesce(split IN ('train', 'validation', 'test'), false) AND NOT {_BLANK("source")} AND NOT {_BLANK("target")} THEN lower({t.sql_text("source")}) END AS s,
  CASE WHEN coalesce(split IN ('train', 'validation', 'test'), false) AND NOT {_BLANK("source")} AND NOT {_BLANK("target")} THEN lower({t.sql_text("target")}) END AS t FROM rec),
fi AS (SELECT rid, min(pos) AS p FROM k WHERE rid IS NOT NULL GROUP BY rid),
ff AS (SELECT family, arg_min(split, pos) AS f FROM k WHERE valid AND NOT {_BLANK("family")} GROUP BY family),
fp AS (SELECT s, t, min(pos) AS p, arg_min(split, pos) AS f FROM k WHERE s IS NOT NULL GROUP BY s, t),
new AS (SELECT k.* FROM k JOIN fp ON fp.s = k.s AND fp.t = k.t AND k.pos = fp.p),
fs AS (SELECT s, arg_min(split, pos) AS f FROM new GROUP BY s), ft AS (SELECT t, arg_min(split, pos) AS f FROM new GROUP BY t),
m AS (SELECT k.*, fi.p AS id_pos, ff.f AS family_split, fp.p AS pair_pos, fp.f AS pair_split, fs.f AS s_split, ft.f AS t_split
  FROM k LEFT JOIN fi ON fi.rid = k.rid LEFT JOIN ff ON ff.family = k.family AND k.valid LEFT JOIN fp ON fp.s = k.s AND fp.t = k.t LEFT JOIN fs ON fs.s = k.s LEFT JOIN ft ON ft.t = k.t),
c AS (SELECT unnest(list_filter([
  CASE WHEN rid IS NULL THEN 'missing_id' END, CASE WHEN {_BLANK("source")} THEN 'missing_source' END, CASE WHEN {_BLANK("target")} THEN 'missing_target' END,
  CASE WHEN NOT valid THEN 'invalid_split' END, CASE WHEN review_status IS DISTINCT FROM 'HUMAN_APPROVED' THEN 'not_human_approved' END,
  CASE WHEN NOT named THEN 'missing_review_identity' END,
  CASE WHEN named AND sole AND NOT ({_PERSON("approver")} = '{OWNER}' AND {_PERSON("reviewer")} = '{OWNER}') THEN 'owner_sole_not_owner' END,
  CASE WHEN named AND NOT sole AND {_OWN} THEN 'self_approval' END,
  CASE WHEN named AND NOT sole AND NOT {_OWN} AND {_PERSON("reviewer")} = {_PERSON("approver")} THEN 'reviewer_is_approver' END,
  CASE WHEN {_BLANK("approval_version")} THEN 'missing_approval_version' END, CASE WHEN {_BLANK("source_id")} THEN 'missing_provenance' END,
  CASE WHEN NOT may_train THEN 'training_rights_not_cleared' END, CASE WHEN origin NOT IN ('en', 'ctd') THEN 'invalid_origin_language' END,
  CASE WHEN valid AND {_BLANK("family")} THEN 'missing_split_family_id' END, CASE WHEN pos > id_pos THEN 'duplicate_id' END,
  CASE WHEN family_split <> split THEN 'split_family_leakage' END, CASE WHEN pos > pair_pos AND pair_split = split THEN 'duplicate_pair' END,
  CASE WHEN pos > pair_pos AND pair_split <> split THEN 'duplicate_pair_across_splits' END,
  CASE WHEN pos = pair_pos AND s_split <> split THEN 'source_across_splits' END, CASE WHEN pos = pair_pos AND t_split <> split THEN 'target_across_splits' END
  ], lambda x: x IS NOT NULL)) AS code FROM m)"""


@query(f"WITH {_GATE_SQL} SELECT code, count(*) AS records FROM c GROUP BY code")
def quality_gate_codes(spark: SparkSession, sf: str) -> DataFrame:
    """How many release records each code of the gate refuses, leaks between splits included. Faults are put in by arithmetic on ids."""
    records = turn_pairs(table(spark, sf, "conversations")).selectExpr(*_record_columns("STRING"))
    return checks.gate_codes(records, OWNER).groupBy("code").agg(F.count("*").alias("records"))


#: Review records made of events, with a fault for every rule.
_REVIEW = {
    "kind": _case(("event_type IN ('purchase', 'error')", "'approval'"), ("event_id % 37 = 1", "'note'"), otherwise="'review'"),
    "pair_hash": _case(("event_id % 13 = 1", "''"), ("event_id % 17 = 1", "'xyz'"), otherwise="sha1(CAST(user_id AS {s}))"),
    "meaning": _case(("event_id % 41 = 1", "NULL"), otherwise="CAST(floor(value) AS BIGINT) % 4"),
    "fluency": "event_id % 3",
    "reviewer": _case(("event_id % 19 = 1", "'Mary'"), ("event_id % 43 = 1", "' '"), otherwise="concat('R', lpad(CAST(event_id % 30 AS {s}), 2, '0'))"),
    "decision": _case(("event_id % 23 = 1", "'maybe'"), ("event_type = 'purchase'", "'approve'"), otherwise="'reject'"),
    "approver": _case(("event_id % 31 = 1", "'E1'"), otherwise="'E01'"),
    "approval": _case(("event_id % 29 = 1", "'owner'"), ("event_id % 5 = 1", "'owner_sole'"), otherwise="NULL"),
}


@query(
    f"""WITH r AS (SELECT {", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in _REVIEW.items())} FROM events),
a AS (SELECT *, list_filter([CASE WHEN {_BLANK("pair_hash")} THEN 'missing pair_hash' END, CASE WHEN kind = 'review' AND meaning IS NULL THEN 'missing meaning' END,
    CASE WHEN kind = 'review' AND fluency IS NULL THEN 'missing fluency' END, CASE WHEN kind = 'review' AND {_BLANK("reviewer")} THEN 'missing reviewer' END,
    CASE WHEN kind = 'approval' AND {_BLANK("decision")} THEN 'missing decision' END, CASE WHEN kind = 'approval' AND {_BLANK("approver")} THEN 'missing approver' END], lambda x: x IS NOT NULL) AS absent,
  list_filter([CASE WHEN NOT regexp_full_match(pair_hash, '[0-9a-f]{{40}}') THEN 'malformed pair_hash' END,
    CASE WHEN kind = 'review' AND NOT (meaning BETWEEN 0 AND 2 AND fluency BETWEEN 0 AND 2) THEN 'score out of range' END,
    CASE WHEN kind = 'review' AND NOT regexp_full_match(reviewer, '[A-Z][0-9]{{2,3}}') THEN 'reviewer is no roster code' END,
    CASE WHEN kind = 'approval' AND decision NOT IN ('approve', 'reject') THEN 'unknown decision' END,
    CASE WHEN kind = 'approval' AND NOT regexp_full_match(approver, '[A-Z][0-9]{{2,3}}') THEN 'approver is no roster code' END,
    CASE WHEN kind = 'approval' AND approval <> 'owner_sole' THEN 'unknown approval' END], lambda x: x IS NOT NULL) AS wrong FROM r)
SELECT error, count(*) AS records FROM (SELECT unnest(CASE WHEN kind = 'note' THEN ['unknown kind'] WHEN len(absent) > 0 THEN absent ELSE wrong END) AS error FROM a) GROUP BY error"""
)
def review_record_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Review and approval records by what is wrong with them."""
    r = table(spark, sf, "events").selectExpr(*[f"{v.format(s='STRING')} AS {k}" for k, v in _REVIEW.items()])
    return r.select(F.explode(checks.review_record_errors(r)).alias("error")).groupBy("error").agg(F.count("*").alias("records"))


_SENSE = {
    "position": "event_id",
    "sense": "user_id",
    "kind": _case(("event_type IN ('purchase', 'error')", "'approval'"), otherwise="'review'"),
    "reviewer": "concat('r', CAST(event_id % 5 AS {s}))",
    "choice": _case(("event_id % 211 = 1", "'wrong'"), ("event_id % 223 = 1", "'not_here'"), ("event_id % 29 = 1", "'fix'"), otherwise="'correct'"),
    "correction": _case(("event_id % 29 = 1", "'better'"), otherwise="NULL"),
    "decision": _case(("event_type = 'purchase'", "'approve'"), otherwise="'reject'"),
    "approval": _case(("event_id % 2 = 1", "'owner_sole'"), otherwise="NULL"),
}


@query(
    f"""WITH log AS (SELECT {", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in _SENSE.items())} FROM events),
rv AS (SELECT * FROM log WHERE kind = 'review' QUALIFY row_number() OVER (PARTITION BY sense, reviewer ORDER BY position DESC) = 1),
f AS (SELECT sense, max(position) AS newest, list_sort(list(reviewer)) AS names, bool_and(choice = 'correct') AS fine, bool_or(choice IN ('wrong', 'not_here')) AS wrong, count(*) FILTER (choice = 'fix') AS corrections FROM rv GROUP BY sense),
a AS (SELECT * FROM log WHERE kind = 'approval' QUALIFY row_number() OVER (PARTITION BY sense ORDER BY position DESC) = 1),
j AS (SELECT f.*, a.decision, a.reviewer AS who, coalesce(a.approval = 'owner_sole', false) AS sole, coalesce(list_contains(names, a.reviewer), false) AS inside,
  coalesce(a.position >= newest AND (NOT list_contains(names, a.reviewer) OR coalesce(a.approval = 'owner_sole', false)), false) AS counts FROM f LEFT JOIN a USING (sense))
SELECT sense, CASE WHEN wrong OR (counts AND decision = 'reject') THEN 'REJECTED' WHEN fine AND counts THEN 'HUMAN_APPROVED' WHEN fine THEN 'READY_FOR_APPROVAL' ELSE 'NEEDS_CORRECTION' END AS status,
  array_to_string(names, ',') AS reviewers, CASE WHEN counts THEN who END AS approver, corrections, counts AND sole AND inside AS sole FROM j"""
)
def sense_review_status(spark: SparkSession, sf: str) -> DataFrame:
    """One status for each reviewed sense of a dictionary, from its log in file order."""
    return checks.decide_senses(table(spark, sf, "events").selectExpr(*[f"{v.format(s='STRING')} AS {k}" for k, v in _SENSE.items()]))


@query(
    """WITH f AS (SELECT p_partkey AS finding, CASE p_size % 5 WHEN 0 THEN 'duplicate_headword' WHEN 1 THEN 'variant' WHEN 2 THEN 'inflected_form' WHEN 3 THEN 'not_standard_form' ELSE 'no_meaning' END AS category, sha1(p_partkey::VARCHAR) AS digest FROM part),
d AS (SELECT user_id AS finding, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'view' THEN 'accept' ELSE 'dismiss' END AS decision, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE sha1(user_id::VARCHAR) END AS seen, event_id % 11 = 0 AS applied
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
j AS (SELECT finding, CASE category WHEN 'duplicate_headword' THEN 'merge_entries' WHEN 'variant' THEN 'standardize' WHEN 'not_standard_form' THEN 'standardize' WHEN 'inflected_form' THEN 'mark_inflected' END AS op,
  category, coalesce(digest = seen, false) AS same FROM d LEFT JOIN f USING (finding) WHERE decision = 'accept' AND NOT applied)
SELECT finding, CASE WHEN same AND op IS NOT NULL THEN op ELSE 'needs_input' END AS op, CASE WHEN NOT same THEN 'changed' WHEN op IS NULL THEN category || ' needs a value' END AS reason FROM j"""
)
def planned_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of the accepted findings that aren't applied yet, and what needs input."""
    size = F.col("p_size") % 5
    category = F.when(size == 0, "duplicate_headword").when(size == 1, "variant").when(size == 2, "inflected_form").when(size == 3, "not_standard_form").otherwise("no_meaning")
    findings = table(spark, sf, "part").select(F.col("p_partkey").alias("finding"), category.alias("category"), F.sha1(F.col("p_partkey").cast("string")).alias("digest"))
    decisions = table(spark, sf, "events").select(
        F.col("event_id").alias("position"), F.col("user_id").alias("finding"), F.when(F.col("event_type").isin("purchase", "view"), "accept").otherwise("dismiss").alias("decision"),
        F.when(F.col("event_id") % 5 == 0, "old").otherwise(F.sha1(F.col("user_id").cast("string"))).alias("digest"), (F.col("event_id") % 11 == 0).alias("applied"),
    )
    return checks.plan_changes(findings, decisions)


@query(
    f"""WITH {SQL["decision_log"]}, r AS (SELECT pair, position, meaning, fluency, CASE WHEN position % 6 = 0 THEN 'better' END AS correction FROM decision_log WHERE kind = 'review' AND reviewer = 'r0'
  QUALIFY row_number() OVER (PARTITION BY pair ORDER BY position DESC) = 1)
SELECT pair, CASE WHEN correction IS NOT NULL AND meaning = 0 THEN 'error_correction_of_a_rejection' WHEN correction IS NOT NULL THEN 'edit_and_approve' WHEN meaning = 2 AND fluency >= 1 THEN 'approve'
  WHEN meaning = 0 THEN 'reject' ELSE 'needs_recheck' END AS outcome FROM r"""
)
def owner_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """What the owner's own latest reviews decide in the same pass."""
    from ..operators.folds import latest
    from ..sources.views import decision_log

    own = decision_log(table(spark, sf, "events")).where("kind = 'review' AND reviewer = 'r0'")
    reviews = latest(own.select("pair", "position", "meaning", "fluency"), ["pair"])
    return checks.owner_outcomes(reviews.withColumn("correction", F.when(F.col("position") % 6 == 0, "better")))


#: Domains that an evaluation set must cover.
DOMAINS = ("everyday", "news", "religion", "health", "law")
_ITEM = {
    "id": _case(("item_id % 67 = 1", "'i1'"), otherwise="concat('i', CAST(item_id AS {s}))"),
    "text": _case(("item_id % 19 = 1", "' '"), otherwise="text"),
    "direction": _case(("item_id % 23 = 1", "'en-my'"), ("item_id % 29 = 1", "'ctd-en'"), otherwise="'en-ctd'"),
    "domain": _case(("item_id % 31 = 1", "'sport'"), ("item_id % 4 = 0", "'news'"), ("item_id % 4 = 1", "'health'"), ("item_id % 4 = 2", "'law'"), otherwise="'everyday'"),
    "outcome": _case(("item_id % 5 = 1", "'adjudicated'"), ("item_id % 37 = 1", "'unknown'"), otherwise="'accepted'"),
    "translator": "concat('t', CAST(item_id % 3 AS {s}))",
    "reviewer": _case(("item_id % 7 = 1", "concat('t', CAST(item_id % 3 AS {s}))"), otherwise="'v'"),
    "adjudicator": _case(("item_id % 10 = 1", "NULL"), ("item_id % 11 = 1", "'v'"), otherwise="'a'"),
}
_DOMAIN_LIST = ", ".join(f"'{d}'" for d in DOMAINS)


@query(
    f"""WITH i AS (SELECT {", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in _ITEM.items())}, item_id AS pos FROM benchmark),
m AS (SELECT i.*, pos > min(pos) OVER (PARTITION BY id) AS again FROM i),
e AS (SELECT unnest(list_filter([CASE WHEN {_BLANK("text")} THEN 'empty text' END, CASE WHEN again THEN 'duplicate id' END, CASE WHEN direction NOT IN ('en-ctd', 'ctd-en') THEN 'unknown direction' END,
  CASE WHEN domain NOT IN ({_DOMAIN_LIST}) THEN 'unknown domain' END, CASE WHEN outcome NOT IN ('accepted', 'revised', 'adjudicated') THEN 'unknown outcome' END, CASE WHEN translator = reviewer THEN 'reviewer is the translator' END,
  CASE WHEN outcome = 'adjudicated' AND adjudicator IS NULL THEN 'no adjudicator' END, CASE WHEN adjudicator IN (translator, reviewer) THEN 'adjudicator is translator or reviewer' END], lambda x: x IS NOT NULL)) AS finding FROM m)
SELECT finding, count(*) AS items FROM e GROUP BY finding
UNION ALL SELECT 'several directions', count(*) FROM m WHERE direction IN ('en-ctd', 'ctd-en') HAVING count(DISTINCT direction) > 1
UNION ALL SELECT 'no items for ' || d, 0 FROM (SELECT unnest([{_DOMAIN_LIST}]) AS d) WHERE d NOT IN (SELECT domain FROM m)"""
)
def eval_item_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items by what blocks the set, and the domains it lacks."""
    i = table(spark, sf, "benchmark").selectExpr(*[f"{v.format(s='STRING')} AS {k}" for k, v in _ITEM.items()], "item_id AS pos")
    m = i.join(i.groupBy("id").agg(F.min("pos").alias("first")), "id")
    known = F.col("direction").isin("en-ctd", "ctd-en")
    found = checks.codes(
        (checks.blank("text"), "empty text"), (F.col("pos") > F.col("first"), "duplicate id"), (~known, "unknown direction"), (~F.col("domain").isin(*DOMAINS), "unknown domain"),
        (~F.col("outcome").isin("accepted", "revised", "adjudicated"), "unknown outcome"), (F.col("translator") == F.col("reviewer"), "reviewer is the translator"),
        ((F.col("outcome") == "adjudicated") & F.col("adjudicator").isNull(), "no adjudicator"),
        (F.col("adjudicator").isin(F.col("translator"), F.col("reviewer")), "adjudicator is translator or reviewer"),
    )
    rows = m.select(F.explode(found).alias("finding")).groupBy("finding").agg(F.count("*").alias("items"))
    mixed = i.where(known).agg(F.count("*").alias("items"), F.countDistinct("direction").alias("n")).where("n > 1").select(F.lit("several directions").alias("finding"), "items")
    domains = spark.createDataFrame([(d,) for d in DOMAINS], "domain string").join(i.select("domain").distinct(), "domain", "left_anti")
    return rows.unionByName(mixed).unionByName(domains.select(F.concat(F.lit("no items for "), "domain").alias("finding"), F.lit(0).cast("long").alias("items")))


@query(
    r"""SELECT p_partkey AS id, array_to_string(list_transform(regexp_extract_all('[' || p_type || ' / review Required] [Working reference ' || p_brand || ']', '\[([^\]]+)\]', 1),
  lambda x: CASE WHEN starts_with(lower(x), 'working reference') THEN 'working_reference' ELSE trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') END), ',') AS flags FROM part"""
)
def notice_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of the notices of reference entries."""
    notice = F.concat(F.lit("["), "p_type", F.lit(" / review Required] [Working reference "), "p_brand", F.lit("]"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(checks.notice_flags(notice), ",").alias("flags"))


@query(
    """SELECT lang, arg_max(source, (-issues, docs, source)) AS source, max(docs) FILTER ((-issues, docs, source) = best) AS docs FROM (
  SELECT *, max((-issues, docs, source)) OVER (PARTITION BY lang) AS best FROM (SELECT lang, source, count(*) FILTER (text IS NULL OR n_chars < 200) AS issues, count(*) AS docs FROM documents GROUP BY lang, source)) GROUP BY lang"""
)
def best_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Of the folders that carry one abbreviation that with the fewest issues, then the most documents."""
    issues = F.count_if(F.col("text").isNull() | (F.col("n_chars") < 200))
    folders = table(spark, sf, "documents").groupBy("lang", "source").agg(issues.alias("issues"), F.count("*").alias("docs"))
    best = F.max(F.struct(-F.col("issues"), "docs", "source")).alias("best")
    return folders.groupBy("lang").agg(best).select("lang", "best.source", "best.docs")


@query(
    """SELECT direction, count(*) AS records FROM (SELECT CASE lower(trim(a)) WHEN 'zom' THEN 'ctd' ELSE lower(trim(a)) END || '-' || CASE lower(trim(b)) WHEN 'zom' THEN 'ctd' ELSE lower(trim(b)) END AS direction
  FROM (SELECT CASE event_id % 4 WHEN 0 THEN ' EN' WHEN 1 THEN 'zom' WHEN 2 THEN 'CTD ' ELSE 'my' END AS a, CASE WHEN event_id % 3 = 0 THEN 'Zom' ELSE 'en' END AS b FROM events)) WHERE direction IN ('en-ctd', 'ctd-en') GROUP BY direction"""
)
def canonical_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Records by canonical direction, those that can't be searched left out."""
    e, n = table(spark, sf, "events"), F.col("event_id") % 4
    a = F.when(n == 0, " EN").when(n == 1, "zom").when(n == 2, "CTD ").otherwise("my")
    b = F.when(F.col("event_id") % 3 == 0, "Zom").otherwise("en")
    code = lambda c: F.when(F.lower(F.trim(c)) == "zom", "ctd").otherwise(F.lower(F.trim(c)))
    named = e.select(F.concat(code(a), F.lit("-"), code(b)).alias("direction"))
    return named.where(F.col("direction").isin("en-ctd", "ctd-en")).groupBy("direction").agg(F.count("*").alias("records"))
