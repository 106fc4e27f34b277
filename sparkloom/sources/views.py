"""Corpus-shaped views over the base tables.

The engine's inputs are pairs of sentences, single sentences, versioned
verses, decision logs and ledgers; these functions shape raw tables into
them. None of them shuffles unless its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered


#: Bytes a core up to which the rows of a table are dealt out to all cores.
SPREAD_UP_TO = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out to all cores if there are few of them: a small file of one row group would be one task.

    Larger tables come in as many tasks as their files have parts and aren't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPREAD_UP_TO else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents, whose rows are much work each, spread over the cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, line_no (from 0), line: every non-blank line of every text."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", "lang", "source", F.posexplode(parts).alias("line_no", "line")).where(F.trim("line") != "")


def line_pairs(docs: DataFrame) -> DataFrame:
    """id, doc_id, source, model, source_text, target_text: each line with the next, both non-blank.

    Neighbours come from the text's own array of lines, so nothing is shuffled.
    """
    parted = docs.select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("parts")).where(F.size("parts") > 1)
    zipped = F.arrays_zip(
        F.slice("parts", F.lit(1), F.size("parts") - 1).alias("source_text"), F.slice("parts", F.lit(2), F.size("parts") - 1).alias("target_text")
    )
    return (
        parted.select("doc_id", "source", F.posexplode(zipped).alias("n", "p"))
        .select(
            (F.col("doc_id") * 1000000 + F.col("n")).alias("id"), "doc_id", "source",
            F.concat(F.lit("m"), F.pmod("doc_id", F.lit(4))).alias("model"),
            F.col("p.source_text").alias("source_text"), F.col("p.target_text").alias("target_text"),
        )
        .where((F.trim("source_text") != "") & (F.trim("target_text") != ""))
    )


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """id, conv_id, model, source_text, target_text: a user's turn with the assistant's next. One shuffle on the conversation."""
    user = conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source_text"))
    reply = conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("target_text"))
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("id"), "conv_id",
        F.concat(F.lit("m"), F.pmod("conv_id", F.lit(4))).alias("model"), "source_text", "target_text",
    )


def verses(docs: DataFrame) -> DataFrame:
    """version, book, chapter, verse, text, doc_id: documents of one language in id order, a hundred to a book.

    The rank is made by ranges of ids, see numbered: no language goes through
    one task. Real versioned corpora carry these keys and skip it.
    """
    ranked = numbered(docs.select("lang", "doc_id", "text"), "doc_id", "nth", within="lang").withColumn("k", F.col("nth") - 1)
    return ranked.select(
        F.col("lang").alias("version"), F.floor(F.col("k") / 100).cast("int").alias("book"),
        F.floor(F.col("k") / 10 % 10).cast("int").alias("chapter"), (F.col("k") % 10).cast("int").alias("verse"), "text", "doc_id",
    )


def decision_log(events: DataFrame) -> DataFrame:
    """position, pair, reviewer, kind, meaning, fluency, decision: an append-only review log.

    Purchases are approvals, errors rejections by an approver; views, clicks
    and signups are reviews with ratings taken from the value.
    """
    review = ~F.col("event_type").isin("purchase", "error")
    rating = F.pmod(F.floor("value").cast("long"), F.lit(4))
    return events.select(
        F.col("event_id").alias("position"), F.col("user_id").alias("pair"),
        F.concat(F.lit("r"), F.pmod("event_id", F.lit(5))).alias("reviewer"),
        F.when(review, "review").otherwise("approval").alias("kind"),
        F.when(review, F.when(rating == 0, F.when(F.pmod("event_id", F.lit(97)) == 0, 0).otherwise(1)).otherwise(2)).cast("int").alias("meaning"),
        F.when(review, F.when(rating == 1, 0).otherwise(2)).cast("int").alias("fluency"),
        F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "error", "reject").alias("decision"),
    )


def ledger(orders: DataFrame) -> DataFrame:
    """household, cents, gift_date, fund, status: orders as gifts, prices in cents."""
    return orders.select(
        F.col("o_custkey").alias("household"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
        F.to_date("o_orderdate").alias("gift_date"), F.col("o_orderpriority").alias("fund"),
        F.when(F.col("o_orderstatus") == "P", "voided").otherwise("posted").alias("status"),
    )


# The same views as DuckDB common table expressions, for the oracles.
SQL = {
    "lines": """
lines AS (SELECT doc_id, lang, source, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT doc_id, lang, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
  WHERE trim(parts[i]) <> '')""",
    "line_pairs": """
line_pairs AS (SELECT doc_id * 1000000 + i - 1 AS id, doc_id, source, 'm' || (doc_id % 4) AS model, parts[i] AS source_text, parts[i + 1] AS target_text
  FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts))) AS u(i)
  WHERE trim(parts[i]) <> '' AND trim(parts[i + 1]) <> '')""",
    "turn_pairs": """
turn_pairs AS (SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, 'm' || (u.conv_id % 4) AS model, u.text AS source_text, a.text AS target_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')""",
    "verses": """
verses AS (SELECT lang AS version, (k // 100)::INT AS book, (k // 10 % 10)::INT AS chapter, (k % 10)::INT AS verse, text, doc_id
  FROM (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents))""",
    "decision_log": """
decision_log AS (SELECT event_id AS position, user_id AS pair, 'r' || (event_id % 5) AS reviewer,
    CASE WHEN event_type IN ('purchase', 'error') THEN 'approval' ELSE 'review' END AS kind,
    CASE WHEN event_type NOT IN ('purchase', 'error') THEN CASE WHEN floor(value)::BIGINT % 4 = 0 THEN CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END ELSE 2 END END AS meaning,
    CASE WHEN event_type NOT IN ('purchase', 'error') THEN CASE WHEN floor(value)::BIGINT % 4 = 1 THEN 0 ELSE 2 END END AS fluency,
    CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' END AS decision FROM events)""",
    "ledger": """
ledger AS (SELECT o_custkey AS household, round(o_totalprice * 100)::BIGINT AS cents, o_orderdate::DATE AS gift_date, o_orderpriority AS fund,
    CASE WHEN o_orderstatus = 'P' THEN 'voided' ELSE 'posted' END AS status FROM orders)""",
}
