"""Operations, approvals, revisions and draft items made from decisions and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import record_makers as make
from ..operators.folds import decide, latest
from ..sources.views import SQL, decision_log, table
from .decisions import _DECIDE_SQL
from .registry import query


def _operations(spark: SparkSession, sf: str) -> DataFrame:
    """Findings are the groups of parts under one name and type; proposals are the parts themselves; events decide on both."""
    parts, events = table(spark, sf, "part"), table(spark, sf, "events")
    groups = parts.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("finding"), F.sort_array(F.collect_list("p_partkey")).alias("entries"), F.min("p_brand").alias("source"), F.sum("p_size").alias("size"))
    category = F.when(F.size("entries") > 6, "no_meaning").when(F.col("p_type") == "PROMO", "variant").when(F.col("p_type") == "SMALL", "inflected_form").when(F.col("p_type") == "LARGE", "not_standard_form").otherwise("duplicate_headword")
    findings = groups.select(
        "finding", category.alias("category"), F.sha1(F.concat_ws(",", F.col("entries").cast("array<string>"))).alias("digest"), "entries", F.slice("entries", 1, 3).alias("senses"),
        "source", F.col("p_name").alias("headword"), F.substring_index("p_name", " ", -1).alias("base_headword"),
    )
    decided = events.select(
        F.col("user_id").alias("finding"), F.col("event_id").alias("recorded_at"), F.when(F.col("event_type").isin("purchase", "view", "click"), "accept").otherwise("dismiss").alias("decision"), (F.col("event_id") % 5).alias("r")
    ).join(findings.select("finding", F.col("digest").alias("now")), "finding", "left")
    decisions = decided.select("finding", "recorded_at", "decision", F.when(F.col("r") == 0, "old").otherwise(F.coalesce("now", F.lit("gone"))).alias("digest"))
    kind = F.when(F.col("p_type") == "PROMO", "headword_candidate").when(F.col("p_type") == "SMALL", "alternative_form").when(F.col("p_type") == "LARGE", "definition").when(F.col("p_type") == "MEDIUM", "equivalent").otherwise("note")
    proposals = parts.where("p_size <> 13").select(
        F.col("p_partkey").alias("proposal"), kind.alias("kind"), F.when(F.col("p_size") < 15, "deterministic").when(F.col("p_size") < 30, "provider_assisted").otherwise("human").alias("origin"),
        F.when(F.col("p_size") % 4 > 0, F.col("p_partkey") + 1).alias("target_sense"), F.col("p_name").alias("written"), F.col("p_brand").alias("standard_form"),
    )
    on_proposals = events.select(
        F.col("user_id").alias("proposal"), F.col("event_id").alias("recorded_at"), F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type").isin("signup", "view"), "edit").otherwise("reject").alias("decision"),
        F.when(F.col("value") > 50, F.concat(F.lit("own "), F.col("user_id"))).alias("edited_text"),
    )
    applied = events.where("event_id % 7 = 0").select(F.concat(F.lit("headword:"), "user_id", F.lit(":"), "event_id").alias("decision"))
    return make.changeset_operations(findings, decisions, proposals, on_proposals, applied)


_OPS_SQL = """g AS (SELECT p_name, p_type, min(p_partkey) AS finding, list_sort(list(p_partkey)) AS entries, min(p_brand) AS source FROM part GROUP BY p_name, p_type),
f AS (SELECT *, CASE WHEN len(entries) > 6 THEN 'no_meaning' ELSE CASE p_type WHEN 'PROMO' THEN 'variant' WHEN 'SMALL' THEN 'inflected_form' WHEN 'LARGE' THEN 'not_standard_form' ELSE 'duplicate_headword' END END AS category FROM g),
d AS (SELECT user_id AS finding, event_id AS made_at, event_type IN ('purchase', 'view', 'click') AS yes FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
h AS (SELECT 'headword:' || d.finding || ':' || made_at AS decision, f.*, f.finding IS NOT NULL AND made_at % 5 <> 0 AS same FROM d LEFT JOIN f ON f.finding = d.finding WHERE yes AND made_at % 7 <> 0),
hx AS (SELECT decision, category, same, entries, source, p_name, unnest(CASE WHEN same AND category IN ('variant', 'not_standard_form') THEN entries[1:3] ELSE [NULL] END) AS sense FROM h),
ho AS (SELECT decision, CASE WHEN NOT same THEN 'needs_input' ELSE CASE category WHEN 'duplicate_headword' THEN 'merge_entries' WHEN 'variant' THEN 'standardize' WHEN 'not_standard_form' THEN 'standardize' WHEN 'inflected_form' THEN 'mark_inflected' ELSE 'needs_input' END END AS op,
  'deterministic' AS origin, false AS provider_derived, CASE WHEN NOT same THEN 'reason=the finding is gone or has changed' ELSE CASE category WHEN 'duplicate_headword' THEN 'keep=' || entries[1] || chr(10) || 'remove=' || array_to_string(entries[2:], ',')
  WHEN 'variant' THEN 'sense=' || sense WHEN 'not_standard_form' THEN 'sense=' || sense WHEN 'inflected_form' THEN 'source=' || source || chr(10) || 'headword=' || p_name || chr(10) || 'base_headword=' || string_split(p_name, ' ')[-1]
  ELSE 'reason=' || category || ' needs a value' END END AS payload FROM hx),
pd AS (SELECT user_id AS proposal, event_id AS made_at, CASE WHEN event_type = 'purchase' THEN 'accept' WHEN event_type IN ('signup', 'view') THEN 'edit' ELSE 'reject' END AS decision, CASE WHEN value > 50 THEN 'own ' || user_id END AS edited
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
p AS (SELECT 'proposal:' || pd.proposal || ':' || made_at AS decision, CASE WHEN pd.decision = 'edit' THEN coalesce(edited, '') ELSE '' END AS own, p_partkey, p_name, p_brand, CASE p_type WHEN 'PROMO' THEN 'headword_candidate' WHEN 'SMALL' THEN 'alternative_form' WHEN 'LARGE' THEN 'definition' WHEN 'MEDIUM' THEN 'equivalent' ELSE 'note' END AS kind,
  CASE WHEN p_partkey IS NULL THEN '' WHEN p_size < 15 THEN 'deterministic' WHEN p_size < 30 THEN 'provider_assisted' ELSE 'human' END AS origin, CASE WHEN p_size % 4 > 0 THEN p_partkey + 1 END AS sense
  FROM pd LEFT JOIN part ON p_partkey = pd.proposal AND p_size <> 13 WHERE pd.decision <> 'reject'),
po AS (SELECT *, CASE WHEN p_partkey IS NULL THEN 'needs_input' WHEN kind IN ('headword_candidate', 'alternative_form') THEN 'add_headword' WHEN sense IS NULL THEN 'needs_input' WHEN kind IN ('definition', 'equivalent') AND (own <> '' OR origin = 'deterministic') THEN 'set_definition' ELSE 'annotate_sense' END AS op FROM p),
ops AS (SELECT * FROM ho UNION ALL SELECT decision, op, origin, origin = 'provider_assisted', CASE WHEN p_partkey IS NULL THEN 'reason=the proposal isn''t there' ELSE CASE op WHEN 'add_headword' THEN 'word=' || p_name || chr(10) || 'meaning=' || own || chr(10) || 'variant_of=' || p_brand
  WHEN 'needs_input' THEN 'reason=' || kind || ' has no sense to attach to' WHEN 'set_definition' THEN 'sense=' || sense || chr(10) || 'text=' || CASE WHEN own <> '' THEN own ELSE p_name END
  ELSE 'sense=' || sense || chr(10) || 'kind=' || kind || chr(10) || 'value=' || CASE WHEN own <> '' THEN own ELSE p_name END END END FROM po)"""


@query(f"WITH {_OPS_SQL} SELECT decision, op, origin, provider_derived, payload FROM ops")
def changeset_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted decision that isn't applied yet as an operation with its payload."""
    return _operations(spark, sf)


@query(
    f"""WITH {_OPS_SQL}, s AS (SELECT sum(('0x' || left(sha1(decision || chr(10) || op || chr(10) || origin || chr(10) || provider_derived::VARCHAR || chr(10) || payload), 12))::HUGEINT)::VARCHAR AS total, count(*) AS operations FROM ops WHERE op <> 'needs_input')
SELECT 'C-' || left(sha1(coalesce(total, '0') || ':' || operations), 12) AS changeset_id, operations FROM s"""
)
def changeset_identity(spark: SparkSession, sf: str) -> DataFrame:
    """The changeset's name, from its operations."""
    return make.changeset_id(_operations(spark, sf))


APPROVER = "r4"
_TEXT_SQL = "sha1(o_orderpriority || ':' || o_totalprice::VARCHAR)"


@query(
    f"""WITH {_DECIDE_SQL}, sheet AS (SELECT o_orderkey AS item, o_custkey AS pair, lower(trim(CASE o_orderstatus WHEN 'F' THEN ' Approve' WHEN 'O' THEN 'reject' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'maybe' ELSE '' END END)) AS decision, o_orderpriority = '5-LOW' AS differs FROM orders)
SELECT item, s.pair, s.decision, NULL::VARCHAR AS approval, CASE WHEN s.decision NOT IN ('approve', 'reject') THEN 'unknown_decision' WHEN differs THEN 'text_differs' WHEN coalesce(status, '') <> 'READY_FOR_APPROVAL' THEN 'not_ready:' || coalesce(status, 'not reviewed')
  WHEN list_contains(string_split(reviewers, ','), '{APPROVER}') THEN 'reviewed_it_too' END AS error FROM sheet s LEFT JOIN decided d ON d.pair = s.pair WHERE s.decision <> ''"""
)
def sheet_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """A lead editor's approval sheet as records, or why a row makes none."""
    status = F.col("o_orderstatus")
    decision = F.when(status == "F", " Approve").when(status == "O", "reject").when(F.col("o_orderkey") % 3 == 0, "maybe").otherwise("")
    text = F.sha1(F.concat_ws(":", "o_orderpriority", F.col("o_totalprice").cast("string")))
    sheet = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("pair"), decision.alias("decision"), text.alias("digest"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise(text).alias("sheet_digest")
    )
    return make.approvals(sheet, decide(decision_log(table(spark, sf, "events"))), APPROVER, "lead_editor")


@query(
    f"""WITH {SQL["decision_log"]}, r AS (SELECT pair, position, meaning, fluency FROM decision_log WHERE kind = 'review' AND reviewer = 'r0' QUALIFY row_number() OVER (PARTITION BY pair ORDER BY position DESC) = 1),
x AS (SELECT pair, meaning, fluency, CASE WHEN position % 3 = 0 THEN 'cold  widget' WHEN position % 7 = 0 THEN 'better' ELSE '' END AS fix, coalesce(p_name, '') AS shown FROM r LEFT JOIN part ON p_partkey = pair),
y AS (SELECT *, trim(regexp_replace(fix, '\\s+', ' ', 'g')) AS f FROM x)
SELECT pair, CASE WHEN f <> '' THEN 'revision' ELSE 'approval' END AS kind, CASE WHEN f = '' THEN 'approve' END AS decision, CASE WHEN f <> '' THEN shown END AS before, CASE WHEN f <> '' THEN f END AS after,
  CASE WHEN f <> '' AND meaning = 0 THEN 'meaning_rejects' WHEN f <> '' AND f = shown THEN 'nothing_changes' WHEN f <> '' AND shown = '' THEN 'text_unknown' END AS error FROM y WHERE f <> '' OR (meaning = 2 AND fluency >= 1)"""
)
def owner_pass_records(spark: SparkSession, sf: str) -> DataFrame:
    """The owner's own latest reviews as approvals and revisions of the same pass."""
    own = decision_log(table(spark, sf, "events")).where("kind = 'review' AND reviewer = 'r0'")
    reviews = latest(own.select("pair", "position", "meaning", "fluency"), ["pair"])
    fix = F.when(F.col("position") % 3 == 0, "cold  widget").when(F.col("position") % 7 == 0, "better").otherwise("")
    shown = table(spark, sf, "part").select(F.col("p_partkey").alias("pair"), F.col("p_name").alias("shown"))
    return make.owner_records(reviews.withColumn("correction", fix).join(shown, "pair", "left"))


TOPICS = ("news", "health", "law", "everyday")


@query(
    """WITH i AS (SELECT item_id AS id, CASE item_id % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'health' WHEN 2 THEN 'law' WHEN 3 THEN 'everyday' ELSE 'sport' END AS domain, text AS source_text, CASE WHEN length(text) % 3 > 0 THEN reverse(text) ELSE ' ' END AS translation FROM benchmark)
SELECT id, 'en-de' AS direction, domain, source_text, translation AS reference, CASE WHEN trim(translation) = '' THEN 'blank' WHEN domain = 'sport' THEN 'unknown_topic' ELSE 'pending' END AS outcome FROM i"""
)
def sheet_draft_items(spark: SparkSession, sf: str) -> DataFrame:
    """A translation sheet's rows as draft items, those not translated, and those with a topic that isn't known."""
    n = F.col("item_id") % 5
    topic = F.when(n == 0, "news").when(n == 1, "health").when(n == 2, "law").when(n == 3, "everyday").otherwise("sport")
    sheet = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), topic.alias("topic"), F.col("text").alias("source_text"), F.when(F.char_length("text") % 3 > 0, F.reverse("text")).otherwise(" ").alias("translation"), F.lit(None).cast("string").alias("notes")
    )
    made = make.draft_items(sheet, TOPICS, "en-de", "t1", "own")
    return made.select("id", "direction", "domain", "source_text", F.coalesce(F.get("references", F.lit(0)), F.lit(" ")).alias("reference"), "outcome")
