"""Rights, conformance, eligibility, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.records import decide_rights, problems, with_rights
from ..sources.views import SQL, ledger, table
from .registry import query

#: A register in the shape of the configuration file: sources 0 to 19 of the documents.
REGISTER = {
    f"src{i}": {
        "status": "cleared" if i % 3 else "needs_review",
        "uses": {"training": "denied"} if i % 5 == 4 else {},
        "components": (f"src{i - 1}",) if i in (7, 8) else (),
    }
    for i in range(19)
}


def _register_sql() -> str:
    rows = ", ".join(f"('{s}', {str(ok).lower()}, '{why}')" for s, (ok, why) in sorted(decide_rights(REGISTER, "training").items()))
    return f"register(source, ok, why) AS (VALUES {rows})"


@query(f"WITH {_register_sql()} SELECT doc_id, source FROM documents JOIN register USING (source) WHERE ok")
def rights_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose source is cleared for training."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    return with_rights(d, "source", decide_rights(REGISTER, "training")).where("allowed").select("doc_id", "source")


@query(
    f"""WITH {_register_sql()} SELECT source, coalesce(why, 'unknown_source') AS reason, count(*) AS records FROM documents LEFT JOIN register USING (source) WHERE NOT coalesce(ok, false) GROUP BY ALL"""
)
def rights_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source")
    return with_rights(d, "source", decide_rights(REGISTER, "training")).where("NOT allowed").groupBy("source", "reason").agg(F.count("*").alias("records"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is empty' END,
  CASE WHEN text <> trim(text) THEN 'text has outer spaces' END,
  CASE WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'text has control characters' END,
  CASE WHEN regexp_matches(text, '[ÃÂâ][\x{80}-\x{BF}]') THEN 'text is mojibake' END,
  CASE WHEN lang NOT IN ('en', 'fr', 'de', 'es') OR lang IS NULL THEN 'lang is unknown' END,
  CASE WHEN NOT regexp_full_match(source, 'src[0-9]+') OR source IS NULL THEN 'source is malformed' END,
  CASE WHEN n_chars <> length(text) THEN 'n_chars differs' END], lambda x: x IS NOT NULL), '; ') AS problems FROM documents"""
)
def record_conformance(spark: SparkSession, sf: str) -> DataFrame:
    """Every record with the rules it breaks."""
    x = F.col("text")
    rules = {
        "text is empty": x.isNull() | (F.trim(x) == ""),
        "text has outer spaces": x != F.trim(x),
        "text has control characters": x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"),
        "text is mojibake": x.rlike("[ÃÂâ][\\x80-\\xBF]"),
        "lang is unknown": F.col("lang").isNull() | ~F.col("lang").isin("en", "fr", "de", "es"),
        "source is malformed": F.col("source").isNull() | ~F.col("source").rlike("^src[0-9]+$"),
        "n_chars differs": F.col("n_chars") != F.char_length(x),
    }
    return table(spark, sf, "documents").select("doc_id", F.array_join(problems(rules), "; ").alias("problems"))


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that more than one record has."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("times")).where("times > 1")


_CONSENT_SQL = """last AS (SELECT user_id, arg_max(event_type, event_id) AS choice, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id),
speakers AS (SELECT c_custkey AS speaker, c_nationkey AS source, choice, value FROM customer LEFT JOIN last ON last.user_id = c_custkey)"""


@query(
    f"""WITH {_CONSENT_SQL} SELECT source, bool_and(coalesce(choice NOT IN ('error'), false)) AND bool_and(coalesce(value >= 1, false)) AS eligible,
  count(*) FILTER (choice IS NULL) AS missing, count(*) FILTER (choice = 'error') AS withdrawn, count(*) FILTER (value < 1) AS refused, count(*) AS speakers FROM speakers GROUP BY source"""
)
def speech_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """A source is usable if every speaker's latest consent is there, not withdrawn and says yes; every reason is counted."""
    e = table(spark, sf, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("choice"), F.max_by("value", "event_id").alias("value"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("speaker"), F.col("c_nationkey").alias("source"))
    s = c.join(last, F.col("speaker") == F.col("user_id"), "left")
    return s.groupBy("source").agg(
        (F.bool_and(F.coalesce(F.col("choice") != "error", F.lit(False))) & F.bool_and(F.coalesce(F.col("value") >= 1, F.lit(False)))).alias("eligible"),
        F.count_if(F.col("choice").isNull()).alias("missing"), F.count_if(F.col("choice") == "error").alias("withdrawn"),
        F.count_if(F.col("value") < 1).alias("refused"), F.count("*").alias("speakers"),
    )


@query(f"""WITH {SQL["ledger"]} SELECT fund, sum(cents)::BIGINT AS cents, count(*) AS gifts, count(DISTINCT household) AS households FROM ledger WHERE status = 'posted' GROUP BY fund""")
def ledger_by_fund(spark: SparkSession, sf: str) -> DataFrame:
    g = ledger(table(spark, sf, "orders")).where("status = 'posted'").groupBy("fund")
    return g.agg(F.sum("cents").alias("cents"), F.count("*").alias("gifts"), F.countDistinct("household").alias("households"))


@query(
    f"""WITH {SQL["ledger"]}, y AS (SELECT year(gift_date) AS year, month(gift_date) AS month, sum(cents) FILTER (fund = '1-URGENT')::BIGINT AS tithe, sum(cents)::BIGINT AS total FROM ledger WHERE status = 'posted' GROUP BY ALL),
s AS (SELECT DISTINCT y.year, m AS month FROM y, (SELECT unnest(range(1, 13)) AS m))
SELECT s.year, s.month::INT AS month, coalesce(tithe, 0) AS tithe, coalesce(total, 0) AS total FROM s LEFT JOIN y ON y.year = s.year AND y.month = s.month"""
)
def ledger_monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve months of every year, with one fund and all; months without gifts are zero."""
    g = ledger(table(spark, sf, "orders")).where("status = 'posted'")
    y = g.groupBy(F.year("gift_date").cast("long").alias("year"), F.month("gift_date").alias("month")).agg(
        F.sum(F.when(F.col("fund") == "1-URGENT", F.col("cents"))).alias("tithe"), F.sum("cents").alias("total")
    )
    spine = y.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return spine.join(y, ["year", "month"], "left").select("year", "month", F.coalesce("tithe", F.lit(0)).alias("tithe"), F.coalesce("total", F.lit(0)).alias("total"))


@query(
    f"""WITH {SQL["ledger"]} SELECT household, coalesce(fund, 'all') AS fund, sum(cents)::BIGINT AS cents, count(*) AS gifts FROM ledger WHERE status = 'posted' GROUP BY GROUPING SETS ((household, fund), (household))"""
)
def household_statement(spark: SparkSession, sf: str) -> DataFrame:
    """Each household's gifts by fund and in all."""
    g = ledger(table(spark, sf, "orders")).where("status = 'posted'")
    c = F.col
    sets = g.groupingSets([[c("household"), c("fund")], [c("household")]], c("household"), c("fund")).agg(F.sum("cents").alias("cents"), F.count("*").alias("gifts"))
    return sets.select("household", F.coalesce("fund", F.lit("all")).alias("fund"), "cents", "gifts")


@query(
    f"""WITH {SQL["ledger"]} SELECT c_nationkey AS class, count(DISTINCT household) AS contributing, (SELECT count(*) FROM customer k WHERE k.c_nationkey = c.c_nationkey) AS households FROM customer c JOIN ledger ON household = c_custkey WHERE status = 'posted' GROUP BY c_nationkey"""
)
def contributing_households(spark: SparkSession, sf: str) -> DataFrame:
    gave = ledger(table(spark, sf, "orders")).where("status = 'posted'").select("household").distinct()
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = c.join(gave, F.col("c_custkey") == F.col("household"), "left")
    return j.groupBy(F.col("c_nationkey").alias("class")).agg(F.count("household").alias("contributing"), F.count("*").alias("households")).where("contributing > 0")


@query(
    f"""WITH {SQL["ledger"]} SELECT household, cents, gift_date::VARCHAR AS gift_date, fund FROM ledger WHERE year(gift_date) = 1995 AND fund = '5-LOW' AND status = 'posted'"""
)
def ledger_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Gifts of a year and fund, without voided ones."""
    g = ledger(table(spark, sf, "orders"))
    return g.where((F.year("gift_date") == 1995) & (F.col("fund") == "5-LOW") & (F.col("status") == "posted")).select("household", "cents", F.col("gift_date").cast("string"), "fund")


@query(
    """WITH d AS (SELECT o_custkey AS household, min(o_orderdate)::DATE AS born FROM orders GROUP BY o_custkey), n AS (SELECT household, born,
  CASE WHEN make_date(1996, month(born), least(day(born), 28)) >= DATE '1996-03-01' THEN make_date(1996, month(born), least(day(born), 28)) ELSE make_date(1997, month(born), least(day(born), 28)) END AS next FROM d)
SELECT household, next::VARCHAR AS next, (next - DATE '1996-03-01')::INT AS days_left FROM n WHERE next - DATE '1996-03-01' <= 30"""
)
def upcoming_anniversaries(spark: SparkSession, sf: str) -> DataFrame:
    """Anniversaries of the first gift in the thirty days from a date."""
    d = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("household")).agg(F.to_date(F.min("o_orderdate")).alias("born"))
    today, day = F.to_date(F.lit("1996-03-01")), F.least(F.dayofmonth("born"), F.lit(28))
    this, other = F.make_date(F.lit(1996), F.month("born"), day), F.make_date(F.lit(1997), F.month("born"), day)
    n = d.select("household", F.when(this >= today, this).otherwise(other).alias("next"))
    return n.select("household", F.col("next").cast("string").alias("next"), F.date_diff("next", today).alias("days_left")).where("days_left <= 30")


@query(
    """SELECT user_id AS learner, count(*) AS sessions, count(*) FILTER (event_type IN ('view', 'click')) AS attended, count(DISTINCT CASE WHEN event_type = 'view' THEN floor(value)::BIGINT END) AS lessons FROM events GROUP BY user_id"""
)
def learner_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("learner")).agg(
        F.count("*").alias("sessions"), F.count_if(F.col("event_type").isin("view", "click")).alias("attended"),
        F.countDistinct(F.when(F.col("event_type") == "view", F.floor("value"))).alias("lessons"),
    )


#: Ids in one leaf of a membership digest.
LEAF = 4096


@query(
    f"""WITH leaf AS (SELECT source, doc_id // {LEAF} AS k, sha256(array_to_string(list(doc_id::VARCHAR ORDER BY doc_id), chr(10))) AS d, count(*) AS n FROM documents GROUP BY ALL),
branch AS (SELECT source, k // {LEAF} AS k, sha256(array_to_string(list(d ORDER BY k), chr(10))) AS d, sum(n) AS n FROM leaf GROUP BY ALL)
SELECT source, sha256(array_to_string(list(d ORDER BY k), chr(10))) AS digest, sum(n)::BIGINT AS members FROM branch GROUP BY source"""
)
def membership_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each source's sorted member ids: a verified subset is known by it.

    A tree of hashes over ranges of ids: a leaf holds at most 4096 ids, a
    branch 4096 leaves, so no list grows with a source until it has billions.
    """
    d = table(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / LEAF).alias("k"))
    leaf = d.groupBy("source", "k").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), "\n"), 256).alias("d"), F.count("*").alias("n"))

    def joined() -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "\n"), 256)

    branch = leaf.groupBy("source", F.floor(F.col("k") / LEAF).alias("up")).agg(joined().alias("d"), F.sum("n").alias("n")).withColumnRenamed("up", "k")
    return branch.groupBy("source").agg(joined().alias("digest"), F.sum("n").alias("members"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS english_sha256, sha1(coalesce(text, '')) AS shown_sha1 FROM documents")
def text_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    x = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.sha2(x, 256).alias("english_sha256"), F.sha1(x).alias("shown_sha1"))


@query(
    f"""WITH e AS (SELECT p_name AS headword, p_type AS pos, min(p_partkey) AS first_id FROM part GROUP BY ALL)
SELECT 'E-' || lpad(row_number() OVER (ORDER BY first_id)::VARCHAR, 6, '0') AS entry_id, headword, pos FROM e"""
)
def entry_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids for entries by their first row: numbered by range partition and the counts before it, not in one task."""
    from ..operators.numbering import numbered

    e = table(spark, sf, "part").groupBy(F.col("p_name").alias("headword"), F.col("p_type").alias("pos")).agg(F.min("p_partkey").alias("first_id"))
    return numbered(e, "first_id").select(F.format_string("E-%06d", "nth").alias("entry_id"), "headword", "pos")
