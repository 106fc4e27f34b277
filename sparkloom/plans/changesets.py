"""Changes of dictionary entries, matched by what they expect to find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.changesets import apply_matched
from ..sources.views import table
from .registry import query


def entries(parts: DataFrame) -> DataFrame:
    """Parts as dictionary rows: name and brand are the headword, type and size its alternatives."""
    return parts.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("headword"), F.concat_ws("; ", "p_type", F.col("p_size").cast("string")).alias("text"),
        F.concat_ws("  ", F.lit("costs"), F.floor("p_retailprice").cast("string")).alias("definition"), F.lit(None).cast("string").alias("notes"),
    )


def proposed(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Events as changes of the part that a user stands for: each expects what the user's last one of its kind left."""
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "set_text", "signup", "set_definition", "error", "add_note", "view", "merge_entries")])
    own = events.select(F.col("event_id").alias("position"), "user_id", F.try_element_at(kind, F.col("event_type")).alias("op"), "value").where("op IS NOT NULL")
    after = F.when(F.col("op") == "add_note", F.concat(F.lit("note "), F.pmod("position", F.lit(3)))).otherwise(F.concat(F.lit("v"), F.floor("value").cast("string"), F.lit(" ;x")))
    own = own.withColumn("after", after).withColumn("previous", F.lag("after").over(Window.partitionBy("user_id", "op").orderBy("position")))
    rows = entries(parts)
    met = own.join(rows.select(F.col("id").alias("user_id"), "headword", "text", "definition"), "user_id", "left")
    stale = F.pmod("position", F.lit(11)) == 0
    first = F.when(F.col("op") == "set_text", F.col("text")).when(F.col("op") == "set_definition", F.regexp_replace("definition", "  ", " "))
    return met.select("position", "op", F.coalesce("headword", F.lit("?")).alias("headword"), F.when(stale, "stale").otherwise(F.coalesce("previous", first)).alias("before"), "after")


_CHANGES_SQL = r"""live AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS headword, p_type || '; ' || p_size AS text, 'costs  ' || floor(p_retailprice)::BIGINT AS definition, NULL::VARCHAR AS notes FROM part),
ev AS (SELECT event_id AS position, user_id, CASE event_type WHEN 'purchase' THEN 'set_text' WHEN 'signup' THEN 'set_definition' WHEN 'error' THEN 'add_note' WHEN 'view' THEN 'merge_entries' END AS op, value FROM events),
ev2 AS (SELECT *, CASE WHEN op = 'add_note' THEN 'note ' || position % 3 ELSE 'v' || floor(value)::BIGINT || ' ;x' END AS after FROM ev WHERE op IS NOT NULL),
ev3 AS (SELECT *, lag(after) OVER (PARTITION BY user_id, op ORDER BY position) AS previous FROM ev2),
ch AS (SELECT position, op, coalesce(headword, '?') AS headword, CASE WHEN position % 11 = 0 THEN 'stale' ELSE coalesce(previous, CASE op WHEN 'set_text' THEN text WHEN 'set_definition' THEN replace(definition, '  ', ' ') END) END AS before, after
  FROM ev3 LEFT JOIN live ON live.id = user_id),
known AS (SELECT * FROM ch WHERE op <> 'merge_entries' AND headword IN (SELECT headword FROM live)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY headword ORDER BY position) AS turn FROM known),
state AS (
  SELECT 0::BIGINT AS k, id, headword, text, definition, notes, NULL::BIGINT AS position, NULL::BIGINT AS n, NULL::VARCHAR AS op FROM live
  UNION ALL
  SELECT k + 1, id, headword, CASE WHEN made AND op = 'set_text' THEN written ELSE text END, CASE WHEN made AND op = 'set_definition' THEN after ELSE definition END,
    CASE WHEN made AND op = 'add_note' THEN CASE WHEN notes IS NULL THEN after ELSE notes || '; ' || after END ELSE notes END, position, n, op
  FROM (SELECT *, hit AND (n = 1 OR op = 'add_note') AS made FROM (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY headword) AS n FROM (
    SELECT s.k, s.id, s.headword, s.text, s.definition, s.notes, r.position, r.op, r.after, array_to_string(list_filter(list_transform(string_split(r.after, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' ; ') AS written,
      CASE r.op WHEN 'set_text' THEN list_filter(list_transform(string_split(s.text, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') = list_filter(list_transform(string_split(r.before, ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')
        WHEN 'set_definition' THEN trim(regexp_replace(s.definition, '\s+', ' ', 'g')) = trim(regexp_replace(r.before, '\s+', ' ', 'g')) ELSE NOT contains(coalesce(s.notes, ''), r.after) END AS hit
    FROM state s JOIN ranked r ON r.headword = s.headword AND r.turn = s.k + 1))))"""


@query(
    f"""WITH RECURSIVE {_CHANGES_SQL}
SELECT position, CASE WHEN n = 0 THEN 'no_match' WHEN n > 1 AND op <> 'add_note' THEN 'ambiguous' ELSE 'applied' END AS outcome FROM (SELECT DISTINCT position, n, op FROM state WHERE position IS NOT NULL)
UNION ALL SELECT position, CASE WHEN op = 'merge_entries' THEN 'not_shown' ELSE 'unknown_headword' END FROM ch WHERE op = 'merge_entries' OR headword NOT IN (SELECT headword FROM live)"""
)
def matched_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every change that is matched by content."""
    parts = table(spark, sf, "part")
    return apply_matched(entries(parts), proposed(table(spark, sf, "events"), parts))[1]


@query(f"WITH RECURSIVE {_CHANGES_SQL} SELECT id, headword, arg_max(text, k) AS text, arg_max(definition, k) AS definition, max(notes) AS notes FROM (SELECT *, max(k) OVER (PARTITION BY id) AS latest FROM state) WHERE k = latest GROUP BY id, headword")
def changed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The dictionary after all changes."""
    parts = table(spark, sf, "part")
    return apply_matched(entries(parts), proposed(table(spark, sf, "events"), parts))[0]
