"""Tiers, gates and exports: what may be published, what is refused and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.folds import decide, wilson
from ..operators.numbering import numbered
from ..operators.records import decide_rights, with_rights
from ..sources.sinks import review_sheets
from ..sources.views import SQL, decision_log, line_pairs, table
from .corpus import _HOLDOUT_SQL, _flagged_sql, _items, _keyed_lines, flagged
from .decisions import _DECIDE_SQL
from .records import REGISTER, _register_sql
from .registry import query

#: A source is trusted if its Wilson lower bound reaches this.
TRUSTED = 0.5


def tiers(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, split, tier: gold by a reviewer, silver by a trusted source, rejected by a reviewer, else unrated."""
    rated = docs.select("doc_id", "source").join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    per = rated.groupBy("source").agg(F.count_if(good).alias("ok"), F.count("quality").alias("n"))
    low, _ = wilson(F.col("ok"), F.col("n"))
    # One row a source; whether it is small enough to broadcast is Spark's decision by its size.
    trusted = per.select("source", F.coalesce(low >= TRUSTED, F.lit(False)).alias("trusted"))
    tier = F.when(good, "gold").when(F.col("quality").isNotNull(), "rejected").when(F.col("trusted"), "silver").otherwise("unrated")
    split = t.hash_split(F.sha1(F.col("doc_id").cast("string")))
    return rated.join(trusted, "source").select("doc_id", "source", split.alias("split"), tier.alias("tier"))


_TIER_SQL = f"""rated AS (SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
per AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS ok, count(quality)::DOUBLE AS n FROM rated GROUP BY source),
trust AS (SELECT source, coalesce((ok / n + 3.8416 / (2 * n) - 1.96 * sqrt(ok / n * (1 - ok / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) >= 0.5, false) AS trusted FROM per),
tiers AS (SELECT doc_id, source, {t.sql_split("sha1(doc_id::VARCHAR)")} AS split, CASE WHEN quality = 1 AND toxic = 0 THEN 'gold' WHEN quality IS NOT NULL THEN 'rejected' WHEN trusted THEN 'silver' ELSE 'unrated' END AS tier
  FROM rated JOIN trust USING (source))"""


@query(f"WITH {_TIER_SQL} SELECT doc_id, split, tier FROM tiers")
def export_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return tiers(table(spark, sf, "documents"), table(spark, sf, "labels")).select("doc_id", "split", "tier")


@query(f"WITH {_TIER_SQL} SELECT split, tier, source, count(*) AS records FROM tiers GROUP BY GROUPING SETS ((split), (split, tier), (split, source))")
def export_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Exported records by split, by split and tier, by split and source: one pass with grouping sets."""
    c = F.col
    g = tiers(table(spark, sf, "documents"), table(spark, sf, "labels")).groupingSets([[c("split")], [c("split"), c("tier")], [c("split"), c("source")]], c("split"), c("tier"), c("source"))
    return g.agg(F.count("*").alias("records"))


@query(
    f"""WITH fam AS (SELECT doc_id, text, lang, {t.sql_family_key("text")} AS family, {t.sql_split("sha1(doc_id::VARCHAR)")} AS split FROM documents),
torn AS (SELECT family FROM fam GROUP BY family HAVING min(split) <> max(split)), twice AS (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
SELECT code, count(*) AS records FROM (SELECT unnest(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' END, CASE WHEN doc_id IN (SELECT doc_id FROM twice) THEN 'duplicate_id' END,
  CASE WHEN lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es') THEN 'unknown_language' END, CASE WHEN family IN (SELECT family FROM torn) THEN 'family_in_two_splits' END,
  CASE WHEN contains(text, chr(65533)) THEN 'bad_unicode' END], lambda x: x IS NOT NULL)) AS code FROM fam) GROUP BY code"""
)
def release_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Error codes that stop a release, and how many records have each. Leaks are found by aggregation over family keys; texts don't travel."""
    d = table(spark, sf, "documents")
    x = F.col("text")
    row_codes = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(x, F.lit(""))) == "", "empty_text"), F.when(F.col("lang").isNull() | ~F.col("lang").isin("en", "fr", "de", "es"), "unknown_language"),
            F.when(F.contains(x, F.lit("�")), "bad_unicode"),
        )
    )
    rows = d.select(F.explode(row_codes).alias("code")).groupBy("code").agg(F.count("*").alias("records"))
    split = t.hash_split(F.sha1(F.col("doc_id").cast("string")))
    families = d.select(t.family_key(x).alias("family"), split.alias("split")).groupBy("family").agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    ids = d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    counted = [
        f.agg(F.sum("n").alias("records")).where("records > 0").select(F.lit(code).alias("code"), "records")
        for f, code in ((families.where("a <> b"), "family_in_two_splits"), (ids, "duplicate_id"))
    ]
    return rows.unionByName(counted[0]).unionByName(counted[1])


@query(
    f"""WITH {_HOLDOUT_SQL}, {_register_sql()}, hit AS (SELECT DISTINCT doc_id FROM l JOIN bk USING (word_form) WHERE word_form <> '')
SELECT CASE WHEN r.source IS NULL THEN 'unknown_source' WHEN NOT ok THEN why WHEN h.doc_id IS NOT NULL THEN 'benchmark_overlap' ELSE 'usable' END AS reason, count(*) AS records
FROM documents d LEFT JOIN register r USING (source) LEFT JOIN hit h USING (doc_id) WHERE {t.sql_split("sha1(d.doc_id::VARCHAR)")} = 'train' GROUP BY ALL"""
)
def training_preflight(spark: SparkSession, sf: str) -> DataFrame:
    """Training documents by what refuses them: the register, then an overlap with the benchmark."""
    d = table(spark, sf, "documents").select("doc_id", "source").where(t.hash_split(F.sha1(F.col("doc_id").cast("string"))) == "train")
    items = _items(spark, sf).where("word_form <> ''").select("word_form").distinct()
    hit = _keyed_lines(spark, sf).join(items, "word_form", "left_semi").select("doc_id").distinct().withColumn("hit", F.lit(True))
    j = with_rights(d, "source", decide_rights(REGISTER, "training")).join(hit, "doc_id", "left")
    reason = F.when(~F.col("allowed"), F.col("reason")).when(F.col("hit"), "benchmark_overlap").otherwise("usable")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("records"))


@query(
    f"""WITH {SQL["turn_pairs"]}, {_flagged_sql("turn_pairs")}
SELECT count(*) AS pairs, count(*) FILTER (len(flags) = 0) AS clean, count(*) FILTER (len(flags) > 0) AS flagged, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
  count(*) FILTER (split = 'test') AS test, round(avg(score), 6) AS mean_score, (SELECT count(*) FROM turn_pairs) - count(*) AS duplicates FROM flagged"""
)
def build_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row about a build: pairs, clean and flagged, splits, mean score, duplicates. Two aggregations, no join of rows."""
    from .corpus import _turns

    turns = _turns(spark, sf)
    of = lambda name: F.count_if(F.col("split") == name).alias(name)
    g = flagged(turns).agg(
        F.count("*").alias("pairs"), F.count_if(F.size("flags") == 0).alias("clean"), F.count_if(F.size("flags") > 0).alias("flagged"),
        of("train"), of("validation"), of("test"), F.round(F.avg("score"), 6).alias("mean_score"),
    )
    return g.crossJoin(F.broadcast(turns.agg(F.count("*").alias("all")))).withColumn("duplicates", F.col("all") - F.col("pairs")).drop("all")


@query(f"""WITH {SQL["line_pairs"]}, {_flagged_sql("line_pairs")} SELECT id, score FROM flagged WHERE split = 'test' AND score >= 0.8 ORDER BY id LIMIT 400""")
def evaluation_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 400 good pairs of the test split: the sampling operator."""
    f = flagged(line_pairs(table(spark, sf, "documents"))).where((F.col("split") == "test") & (F.col("score") >= 0.8))
    return f.select("id", "score").orderBy("id").limit(400)


@query(
    f"""WITH {_DECIDE_SQL} SELECT 'A' || lpad(row_number() OVER (ORDER BY sha1(pair::VARCHAR))::VARCHAR, 5, '0') AS sample_id, pair, reviewers FROM decided WHERE status = 'READY_FOR_APPROVAL'"""
)
def approval_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that wait for approval, numbered in the order of their hash."""
    ready = decide(decision_log(table(spark, sf, "events"))).where("status = 'READY_FOR_APPROVAL'").withColumn("place", F.sha1(F.col("pair").cast("string")))
    return numbered(ready, "place").select(F.format_string("A%05d", "nth").alias("sample_id"), "pair", "reviewers")


@query(
    f"""WITH {_DECIDE_SQL} SELECT 'R' || lpad(row_number() OVER (ORDER BY sha1('9' || pair))::VARCHAR, 5, '0') AS sample_id, pair, status FROM decided WHERE status = 'NEEDS_CORRECTION'"""
)
def correction_key(spark: SparkSession, sf: str) -> DataFrame:
    """The key of a blind sheet: sample ids and what the sheet hides."""
    todo = decide(decision_log(table(spark, sf, "events"))).where("status = 'NEEDS_CORRECTION'").withColumn("place", F.sha1(F.concat(F.lit("9"), F.col("pair").cast("string"))))
    return review_sheets(todo, "place", ["reviewers"], ["pair", "status"])[1]


@query("SELECT event_id, sha256('7' || chr(9) || event_id) AS place FROM events WHERE event_type = 'purchase' ORDER BY place, event_id LIMIT 50")
def spot_check(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty applied changes by seeded hash order: the sampling operator."""
    e = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.sha2(F.concat(F.lit("7\t"), F.col("event_id").cast("string")), 256).alias("place"))
    return e.orderBy("place", "event_id").limit(50)


_REVISE_SQL = f"""{SQL["decision_log"]}, rev AS (SELECT pair, max(position) AS position FROM decision_log WHERE kind = 'review' AND meaning < 2 GROUP BY pair),
no AS (SELECT DISTINCT pair FROM decision_log WHERE decision = 'reject')"""


@query(
    f"""WITH {_REVISE_SQL} SELECT CASE WHEN d.doc_id IS NULL THEN 'not_in_corpus' WHEN no.pair IS NOT NULL THEN 'rejected' WHEN d.lang = 'en' THEN 'already' WHEN d.lang = (['en', 'fr', 'de', 'es'])[position % 4 + 1] THEN 'applied' ELSE 'changed' END AS outcome, count(*) AS revisions
FROM rev LEFT JOIN documents d ON d.doc_id = rev.pair LEFT JOIN no ON no.pair = rev.pair GROUP BY ALL"""
)
def guarded_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """Revisions that are applied only where the current value is the expected one; every other outcome is counted."""
    log = decision_log(table(spark, sf, "events"))
    rev = log.where("kind = 'review' AND meaning < 2").groupBy("pair").agg(F.max("position").alias("position"))
    no = log.where("decision = 'reject'").select("pair").distinct().withColumn("no", F.lit(True))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pair"), F.col("lang").alias("now"), F.lit(True).alias("there"))
    expected = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), F.pmod("position", F.lit(4)).cast("int"))
    outcome = (
        F.when(F.col("there").isNull(), "not_in_corpus").when(F.col("no"), "rejected").when(F.col("now") == "en", "already")
        .when(F.col("now") == expected, "applied").otherwise("changed")
    )
    return rev.join(d, "pair", "left").join(no, "pair", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("revisions"))


@query(
    """WITH ops AS (SELECT user_id, list(struct_pack(e := event_id % 2, n := floor(value)::BIGINT % 2) ORDER BY event_id) AS ops FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id),
r AS (SELECT user_id, list_reduce(list_prepend({'s': 0::BIGINT, 'a': 0::BIGINT, 'u': 0::BIGINT, 'c': 0::BIGINT}, list_transform(ops, lambda o: {'s': o.e, 'a': o.n, 'u': 0::BIGINT, 'c': 0::BIGINT})),
  lambda x, o: {'s': CASE WHEN x.s <> o.a AND x.s = o.s THEN o.a ELSE x.s END, 'a': x.a + (x.s <> o.a AND x.s = o.s)::BIGINT, 'u': x.u + (x.s = o.a)::BIGINT, 'c': x.c + (x.s <> o.a AND x.s <> o.s)::BIGINT}) AS x FROM ops)
SELECT user_id AS target, x.s AS state, x.a AS applied, x.u AS unchanged, x.c AS conflicts FROM r"""
)
def replay_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Changes replayed in order on each target: applied where the state is the expected one, else unchanged or a conflict.

    A target's list is as long as its hand-made changes; states depend on all earlier ones.
    """
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    op = F.struct("event_id", F.pmod("event_id", F.lit(2)).alias("e"), F.pmod(F.floor("value"), F.lit(2)).alias("n"))
    ops = e.groupBy(F.col("user_id").alias("target")).agg(F.sort_array(F.collect_list(op)).alias("ops"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("state"), zero.alias("applied"), zero.alias("unchanged"), zero.alias("conflicts"))

    def step(x, o):
        same, fits = x["state"] == o["n"], x["state"] == o["e"]
        one = lambda c: c.cast("long")
        return F.struct(
            F.when(~same & fits, o["n"]).otherwise(x["state"]).alias("state"), (x["applied"] + one(~same & fits)).alias("applied"),
            (x["unchanged"] + one(same)).alias("unchanged"), (x["conflicts"] + one(~same & ~fits)).alias("conflicts"),
        )

    return ops.select("target", F.aggregate("ops", start, step).alias("x")).select("target", "x.*")


@query(
    """SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN sha1(CASE WHEN l.doc_id % 7 = 0 THEN 'old' ELSE coalesce(text, '') END) = sha1(coalesce(text, '')) THEN 'usable' ELSE 'stale' END AS state, count(*) AS reviews
FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY ALL"""
)
def stale_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews whose shown text is no longer the current one. Digests meet, texts don't travel."""
    d = table(spark, sf, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit(""))).alias("now"))
    r = table(spark, sf, "labels").select("doc_id")
    shown = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.sha1(F.lit("old"))).otherwise(F.col("now"))
    state = F.when(F.col("now").isNull(), "missing").when(shown == F.col("now"), "usable").otherwise("stale")
    return r.join(d, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("reviews"))


@query("SELECT lang, CASE WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'correct' ELSE 'undecided' END AS outcome, count(*) AS drafts FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def merge_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts with their review decisions."""
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    outcome = F.when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "correct").otherwise("undecided")
    return j.groupBy("lang", outcome.alias("outcome")).agg(F.count("*").alias("drafts"))


@query(
    """WITH q AS (SELECT user_id AS id, min(event_id) AS first FROM events GROUP BY user_id), n AS (SELECT id, row_number() OVER (ORDER BY first) AS place FROM q)
SELECT place, id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN l.doc_id IS NOT NULL THEN 'reviewed' ELSE 'open' END AS state FROM n LEFT JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id WHERE place > 20 AND place <= 80"""
)
def queue_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Places 21 to 80 of a queue with what became of each: a page of the queue."""
    q = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("first"))
    page = numbered(q, "first", "place").where("place > 20 AND place <= 80").select("place", "id")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("there"))
    r = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("done"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("done"), "reviewed").otherwise("open")
    return page.join(d, "id", "left").join(r, "id", "left").select("place", "id", state.alias("state"))
