"""Corpus building: normalise, key, flag, dedup, split, hold out, filter, route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as t
from ..operators.dedup import HELD_OUT, keep_best, keep_first, nearest_rank
from ..operators.lineage import checkpointed
from ..sources.views import SQL, line_pairs, lines, table, turn_pairs
from .registry import query


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(table(spark, sf, "documents"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return line_pairs(table(spark, sf, "documents"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return turn_pairs(table(spark, sf, "conversations"))


def flagged(pairs: DataFrame) -> DataFrame:
    """Normalised pairs with key, flags, score and hash split; of equal keys the first."""
    clean = pairs.withColumns({"source_text": t.normalize_text(F.col("source_text")), "target_text": t.normalize_text(F.col("target_text"))})
    keyed = clean.withColumn("pair_hash", t.pair_key(F.col("source_text"), F.col("target_text")))
    first = keep_first(keyed, ["pair_hash"], "id")
    marked = first.withColumn("flags", q.quality_flags(F.col("source_text"), F.col("target_text")))
    return marked.withColumns({"score": q.quality_score(F.col("flags")), "split": t.hash_split(t.family_key(F.col("source_text")))})


def _flagged_sql(view: str) -> str:
    return f"""
{view}_clean AS (SELECT * REPLACE ({t.sql_text("source_text")} AS source_text, {t.sql_text("target_text")} AS target_text) FROM {view}),
{view}_first AS (SELECT * FROM (SELECT *, {t.sql_pair_key("source_text", "target_text")} AS pair_hash FROM {view}_clean)
  QUALIFY row_number() OVER (PARTITION BY pair_hash ORDER BY id) = 1),
{view}_marked AS (SELECT *, {q.sql_flags("source_text", "target_text")} AS flags FROM {view}_first),
flagged AS (SELECT *, {q.sql_score("flags")} AS score, {t.sql_split(t.sql_family_key("source_text"))} AS split FROM {view}_marked)"""


@query(
    f"""WITH {SQL["turn_pairs"]}, {_flagged_sql("turn_pairs")}
SELECT split, flag, count(*) AS pairs FROM (SELECT split, unnest(CASE WHEN len(flags) = 0 THEN ['clean'] ELSE flags END) AS flag FROM flagged) GROUP BY ALL"""
)
def corpus_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs by split and flag after dedup."""
    f = flagged(_turns(spark, sf))
    flag = F.explode(F.when(F.size("flags") == 0, F.array(F.lit("clean"))).otherwise(F.col("flags")))
    return f.select("split", flag.alias("flag")).groupBy("split", "flag").agg(F.count("*").alias("pairs"))


@query(
    f"""WITH {SQL["line_pairs"]}, {_flagged_sql("line_pairs")}
SELECT id, array_to_string(flags, ',') AS flags, score, split FROM flagged"""
)
def line_pair_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every line pair with its flags, score and split."""
    return flagged(_pairs(spark, sf)).select("id", F.array_join("flags", ",").alias("flags"), "score", "split")


@query(f"""WITH {SQL["lines"]} SELECT doc_id, line_no, {t.sql_word("line")} AS word_form FROM lines""")
def normalize_words(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", F.col("line_no").cast("long"), t.normalize_word(F.col("line")).alias("word_form"))


@query(f"""WITH {SQL["lines"]} SELECT doc_id, line_no, nfc_normalize({t.sql_text("line")}) AS text FROM lines""")
def normalize_nfc(spark: SparkSession, sf: str) -> DataFrame:
    """Normal form C through the Arrow UDF, for sources not known to be in it."""
    return _lines(spark, sf).select("doc_id", F.col("line_no").cast("long"), t.nfc(t.normalize_text(F.col("line"))).alias("text"))


@query(
    f"""WITH {SQL["line_pairs"]} SELECT id, {t.sql_pair_key("source_text", "target_text")} AS pair_key, {t.sql_family_key("source_text")} AS family_key FROM line_pairs"""
)
def pair_keys(spark: SparkSession, sf: str) -> DataFrame:
    s, g = F.col("source_text"), F.col("target_text")
    return _pairs(spark, sf).select("id", t.pair_key(s, g).alias("pair_key"), t.family_key(s).alias("family_key"))


@query(f"""WITH {SQL["line_pairs"]} SELECT {t.sql_split(t.sql_family_key("source_text"))} AS split, count(*) AS pairs FROM line_pairs GROUP BY ALL""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).groupBy(t.hash_split(t.family_key(F.col("source_text"))).alias("split")).agg(F.count("*").alias("pairs"))


@query(f"""WITH {SQL["lines"]} SELECT doc_id, line_no, {t.sql_template("line")} AS template FROM lines""")
def template_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", F.col("line_no").cast("long"), t.template_key(F.col("line")).alias("template"))


@query(
    f"""WITH {SQL["lines"]}, k AS (SELECT {t.sql_template("line")} AS k, count(*) AS n FROM lines GROUP BY 1)
SELECT count(*) AS families, max(n) AS largest, count(*) FILTER (n > 1) AS shared FROM k"""
)
def template_families(spark: SparkSession, sf: str) -> DataFrame:
    k = _lines(spark, sf).groupBy(t.template_key(F.col("line")).alias("k")).agg(F.count("*").alias("n"))
    return k.agg(F.count("*").alias("families"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("shared"))


def learned(texts: DataFrame, c: str, least: int = 5, share: float = 0.9) -> DataFrame:
    """word, capitalized, lowercase: names by their use away from the start of a sentence."""
    w = texts.select(F.explode(F.slice(t.words(F.col(c)), 2, 1 << 30)).alias("w")).where((F.char_length("w") >= 2) & F.col("w").rlike(r"^\p{L}+$"))
    upper, lower = F.col("w").rlike(r"^\p{Lu}"), F.col("w") == F.lower("w")
    counted = w.groupBy(F.lower("w").alias("word")).agg(F.count_if(upper).alias("capitalized"), F.count_if(~upper & lower).alias("lowercase"))
    return counted.where((F.col("capitalized") >= least) & (F.col("capitalized") >= share * (F.col("capitalized") + F.col("lowercase"))))


@query(
    f"""WITH {SQL["lines"]}, w AS (SELECT unnest({t.sql_words("line")}[2:]) AS w FROM lines)
SELECT lower(w) AS word, count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) AS capitalized, count(*) FILTER (NOT regexp_matches(w, '^\\p{{Lu}}') AND w = lower(w)) AS lowercase
FROM w WHERE length(w) >= 2 AND regexp_full_match(w, '\\p{{L}}+') GROUP BY 1
HAVING capitalized >= 5 AND capitalized >= 0.9::DOUBLE * (capitalized + lowercase)"""
)
def learned_names(spark: SparkSession, sf: str) -> DataFrame:
    return learned(_lines(spark, sf), "line")


@query(
    f"""WITH {SQL["line_pairs"]} SELECT id FROM line_pairs
WHERE list_sort(regexp_extract_all(source_text, '\\p{{Nd}}+')) <> list_sort(regexp_extract_all(target_text, '\\p{{Nd}}+'))"""
)
def number_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where(q.number_mismatch(F.col("source_text"), F.col("target_text"))).select("id")


_RATIO = "CASE WHEN least(length(source_text), length(target_text)) >= 20 THEN ln(length(target_text) / length(source_text)) END"
_BOUNDS_SQL = f"""r AS (SELECT id, {_RATIO} AS ratio FROM line_pairs),
o AS (SELECT ratio, row_number() OVER (ORDER BY ratio) - 1 AS k, count(*) OVER () AS n FROM r WHERE ratio IS NOT NULL),
b AS (SELECT max(ratio) FILTER (k = round_even(0.005 * (n - 1), 0)) AS low, max(ratio) FILTER (k = round_even(0.995 * (n - 1), 0)) AS high FROM o)"""


def ratio_bounds(pairs: DataFrame) -> DataFrame:
    r = pairs.select(t.length_log_ratio(F.col("source_text"), F.col("target_text")).alias("ratio"))
    return nearest_rank(r, "ratio", {"low": 0.005, "high": 0.995})


@query(f"""WITH {SQL["line_pairs"]}, {_BOUNDS_SQL} SELECT round(low, 6) AS low, round(high, 6) AS high FROM b""")
def length_ratio_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ratio_bounds(_pairs(spark, sf)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""WITH {SQL["line_pairs"]}, {_BOUNDS_SQL} SELECT id FROM r, b WHERE ratio < low - 1e-12 OR ratio > high + 1e-12""")
def length_ratio_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs outside the bounds; the bounds are one row."""
    p = _pairs(spark, sf)
    r = p.select("id", t.length_log_ratio(F.col("source_text"), F.col("target_text")).alias("ratio"))
    return r.crossJoin(F.broadcast(ratio_bounds(p))).where((F.col("ratio") < F.col("low") - 1e-12) | (F.col("ratio") > F.col("high") + 1e-12)).select("id")


def reused(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Targets that translate ``least`` different sources or more."""
    keyed = pairs.select(t.normalize_word(F.col("target_text")).alias("target"), t.family_key(F.col("source_text")).alias("family")).distinct()
    return keyed.groupBy("target").agg(F.count("*").alias("families")).where(F.col("families") >= least)


@query(
    f"""WITH {SQL["line_pairs"]} SELECT {t.sql_word("target_text")} AS target, count(DISTINCT {t.sql_family_key("source_text")}) AS families
FROM line_pairs GROUP BY 1 HAVING families >= 3"""
)
def reused_targets(spark: SparkSession, sf: str) -> DataFrame:
    return reused(_pairs(spark, sf))


_PASS2_SQL = f"""{SQL["line_pairs"]}, {_flagged_sql("line_pairs")}, {_BOUNDS_SQL.replace("FROM line_pairs", "FROM flagged")},
reuse AS (SELECT {t.sql_word("target_text")} AS target FROM flagged GROUP BY 1 HAVING count(DISTINCT {t.sql_family_key("source_text")}) >= 3),
final AS (SELECT f.* REPLACE (f.flags || list_filter([
    CASE WHEN {t.sql_word("f.target_text")} IN (SELECT target FROM reuse) THEN 'target_reused' END,
    CASE WHEN list_sort(regexp_extract_all(source_text, '\\p{{Nd}}+')) <> list_sort(regexp_extract_all(target_text, '\\p{{Nd}}+')) THEN 'number_mismatch' END,
    CASE WHEN ratio < low - 1e-12 OR ratio > high + 1e-12 THEN 'length_ratio_outlier' END], lambda x: x IS NOT NULL) AS flags,
    {t.sql_split(t.sql_template("f.source_text"))} AS split) FROM flagged f JOIN r USING (id), b),
scored AS (SELECT * REPLACE ({q.sql_score("flags")} AS score) FROM final)"""


def checked(pairs: DataFrame) -> DataFrame:
    """Both passes: row flags, then those that need the whole corpus (reuse, numbers, length ratio); score; template split.

    Returns id, flags, score and split of every distinct pair. All that depends
    on a row's texts is worked out where they lie, once; only keys travel.
    """
    clean = pairs.select("id", t.normalize_text(F.col("source_text")).alias("s"), t.normalize_text(F.col("target_text")).alias("g"))
    s, g = F.col("s"), F.col("g")
    words = clean.withColumns({"source_key": t.normalize_word(s), "target_key": t.normalize_word(g)})
    rows = words.select(
        F.sha1(F.concat("source_key", F.lit("\t"), "target_key")).alias("pair_hash"), "id",
        F.sha1("source_key").alias("family"), F.sha1("target_key").alias("target"),
        q.quality_flags(s, g).alias("flags"), q.number_mismatch(s, g).alias("numbers_differ"),
        t.length_log_ratio(s, g).alias("ratio"), t.hash_split(t.template_key(s)).alias("split"),
    )
    first = checkpointed(keep_first(rows, ["pair_hash"], "id"))
    many = first.select("target", "family").distinct().groupBy("target").agg(F.count("*").alias("n")).where("n >= 3")
    met = first.join(many.select("target", F.lit(True).alias("is_reused")), "target", "left")
    bounded = met.crossJoin(F.broadcast(nearest_rank(first.select("ratio"), "ratio", {"low": 0.005, "high": 0.995})))
    more = F.array_compact(
        F.array(
            F.when(F.col("is_reused"), "target_reused"),
            F.when(F.col("numbers_differ"), "number_mismatch"),
            F.when((F.col("ratio") < F.col("low") - 1e-12) | (F.col("ratio") > F.col("high") + 1e-12), "length_ratio_outlier"),
        )
    )
    return bounded.withColumn("flags", F.concat("flags", more)).select("id", "flags", q.quality_score(F.col("flags")).alias("score"), "split")


@query(f"""WITH {_PASS2_SQL} SELECT id, array_to_string(flags, ',') AS flags, score, split FROM scored""")
def corpus_checks(spark: SparkSession, sf: str) -> DataFrame:
    """All flags, the final score and the template split of every distinct line pair."""
    return checked(_pairs(spark, sf)).select("id", F.array_join("flags", ",").alias("flags"), "score", "split")


_HOLDOUT_SQL = f"""{SQL["lines"]},
l AS (SELECT doc_id, line_no, {t.sql_template("line")} AS template, {t.sql_word("line")} AS word_form FROM lines),
b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark),
bk AS (SELECT DISTINCT item_id, {t.sql_template("line")} AS template, {t.sql_word("line")} AS word_form FROM b WHERE trim(line) <> '')"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.trim("line") != "")
    return rows.select("item_id", t.template_key(F.col("line")).alias("template"), t.normalize_word(F.col("line")).alias("word_form")).distinct()


def _keyed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("doc_id", F.col("line_no").cast("long"), t.template_key(F.col("line")).alias("template"), t.normalize_word(F.col("line")).alias("word_form"))


@query(f"""WITH {_HOLDOUT_SQL} SELECT doc_id, line_no FROM l WHERE template IN (SELECT template FROM bk) OR word_form IN (SELECT word_form FROM bk)""")
def eval_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that an evaluation item's template or text holds out: two semi joins, then the union."""
    lined, items = _keyed_lines(spark, sf), _items(spark, sf)
    by = [lined.join(items.select(k).distinct(), k, "left_semi").select("doc_id", "line_no") for k in ("template", "word_form")]
    return by[0].unionByName(by[1]).distinct()


@query(
    f"""WITH {_HOLDOUT_SQL} SELECT item_id, count(DISTINCT (doc_id, line_no)) AS lines_leaked, count(DISTINCT doc_id) AS docs_leaked
FROM l JOIN bk USING (word_form) WHERE word_form <> '' GROUP BY item_id"""
)
def eval_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items whose text occurs in the corpus, and how often."""
    items = _items(spark, sf).where("word_form <> ''").select("item_id", "word_form").distinct()
    met = _keyed_lines(spark, sf).join(items, "word_form")
    return met.groupBy("item_id").agg(F.countDistinct("doc_id", "line_no").alias("lines_leaked"), F.countDistinct("doc_id").alias("docs_leaked"))


@query(f"""WITH {_HOLDOUT_SQL} SELECT item_id, count(*) AS overlaps FROM (SELECT DISTINCT item_id, doc_id, line_no FROM l JOIN bk USING (template)) GROUP BY 1""")
def template_overlap(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).select("item_id", "template").distinct()
    met = _keyed_lines(spark, sf).join(items, "template").select("item_id", "doc_id", "line_no").distinct()
    return met.groupBy("item_id").agg(F.count("*").alias("overlaps"))


@query(f"""WITH {SQL["line_pairs"]} SELECT min(id) AS id, {t.sql_pair_key("source_text", "target_text")} AS pair_hash, count(*) - 1 AS duplicates FROM line_pairs GROUP BY 2""")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each pair key and how many duplicates it has."""
    keyed = _pairs(spark, sf).select("id", t.pair_key(F.col("source_text"), F.col("target_text")).alias("pair_hash"))
    return keyed.groupBy("pair_hash").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("duplicates"))


_ROWS_SQL = f"""{SQL["line_pairs"]},
m AS (SELECT *, {q.sql_flags("source_text", "target_text")} AS flags, {t.sql_split(t.sql_family_key("source_text"))} AS split,
   sha1(trim(source_text) || chr(31) || trim(target_text)) AS pair FROM line_pairs),
rowset AS (SELECT *, {q.sql_score("flags")} AS score, list_filter([
   CASE WHEN lower(trim(source_text)) = lower(trim(target_text)) THEN 'source_copied_as_target' END], lambda x: x IS NOT NULL)
   || list_sort(list_filter(flags, lambda f: f IN ('html_or_script', 'identical', 'invalid_unicode', 'number_mismatch', 'possible_language_mismatch', 'suspicious_repeat'))) AS hard,
   list_sort(list_filter(flags, lambda f: f IN ('extremely_long', 'extremely_short', 'length_ratio_outlier', 'target_reused'))) AS soft FROM m),
best AS (SELECT * FROM rowset WHERE len(hard) = 0 QUALIFY row_number() OVER (PARTITION BY split, pair ORDER BY score DESC, id) = 1),
held AS (SELECT DISTINCT pair FROM rowset WHERE split IN ('validation', 'test')),
routed AS (SELECT w.*, CASE WHEN len(w.hard) > 0 THEN 'quarantine' WHEN w.split = 'train' AND w.pair IN (SELECT pair FROM held) THEN 'held_out_twin'
   WHEN b.id IS NULL THEN 'duplicate' WHEN len(w.soft) > 0 THEN 'review' ELSE 'kept' END AS route FROM rowset w LEFT JOIN best b ON b.id = w.id)"""


def filter_rows(pairs: DataFrame) -> DataFrame:
    """Pairs with flags, score, split, pair digest, hard and soft reasons."""
    s, g = F.col("source_text"), F.col("target_text")
    marked = pairs.withColumns(
        {"flags": q.quality_flags(s, g), "split": t.hash_split(t.family_key(s)), "pair": F.sha1(F.concat(F.trim(s), F.lit("\x1f"), F.trim(g)))}
    )
    return marked.withColumns(
        {"score": q.quality_score(F.col("flags")), "hard": q.hard_reasons(s, g, F.col("flags"), F.lit(False)), "soft": q.soft_reasons(F.col("flags"))}
    )


def routed(pairs: DataFrame) -> DataFrame:
    """Each pair's way: quarantine, held_out_twin, duplicate, review or kept.

    Decisions are made on narrow columns (id, pair, split, score); texts don't travel.
    """
    # Written out: three branches need them, and the patterns of the flags are the dear part.
    rows = checkpointed(filter_rows(pairs).select("id", "model", "pair", "split", "score", "hard", "soft"))
    best = keep_best(rows.where(F.size("hard") == 0).select("id", "pair", "split", "score"), ["split", "pair"], "score", "id").select("id", F.lit(True).alias("is_best"))
    held = rows.where(F.col("split").isin(*HELD_OUT)).select("pair").distinct().withColumn("is_held", F.lit(True))
    joined = rows.join(best, "id", "left").join(held, "pair", "left")
    route = (
        F.when(F.size("hard") > 0, "quarantine")
        .when((F.col("split") == "train") & F.col("is_held").isNotNull(), "held_out_twin")
        .when(F.col("is_best").isNull(), "duplicate")
        .when(F.size("soft") > 0, "review")
        .otherwise("kept")
    )
    return joined.withColumn("route", route).drop("is_best", "is_held")


@query(f"""WITH {_ROWS_SQL} SELECT id, split, score FROM best""")
def dedup_best_per_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_rows(_pairs(spark, sf)).where(F.size("hard") == 0).select("id", "pair", "split", "score")
    return keep_best(rows, ["split", "pair"], "score", "id").select("id", "split", "score")


@query(f"""WITH {_ROWS_SQL} SELECT id FROM rowset WHERE split = 'train' AND pair IN (SELECT pair FROM held)""")
def train_heldout_twins(spark: SparkSession, sf: str) -> DataFrame:
    rows = filter_rows(_pairs(spark, sf)).select("id", "pair", "split")
    held = rows.where(F.col("split").isin(*HELD_OUT)).select("pair").distinct()
    return rows.where("split = 'train'").join(held, "pair", "left_semi").select("id")


@query(f"""WITH {_ROWS_SQL} SELECT id, route, array_to_string(hard, ',') AS hard, array_to_string(soft, ',') AS soft FROM routed""")
def filter_routing(spark: SparkSession, sf: str) -> DataFrame:
    return routed(_pairs(spark, sf)).select("id", "route", F.array_join("hard", ",").alias("hard"), F.array_join("soft", ",").alias("soft"))


@query(
    f"""WITH {_ROWS_SQL} SELECT route, reason, count(*) AS pairs FROM (SELECT route, unnest(CASE WHEN len(hard || soft) = 0 THEN ['none'] ELSE hard || soft END) AS reason FROM routed) GROUP BY ALL"""
)
def filter_summary(spark: SparkSession, sf: str) -> DataFrame:
    both = F.concat("hard", "soft")
    r = routed(_pairs(spark, sf)).select("route", F.explode(F.when(F.size(both) == 0, F.array(F.lit("none"))).otherwise(both)).alias("reason"))
    return r.groupBy("route", "reason").agg(F.count("*").alias("pairs"))


@query(f"""WITH {_ROWS_SQL} SELECT id, len(soft) AS soft_count, score, model FROM routed WHERE route IN ('kept', 'review') ORDER BY len(soft) DESC, score, id LIMIT 100""")
def reaudit_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred kept rows most in need of another look: a top-k report."""
    r = routed(_pairs(spark, sf)).where(F.col("route").isin("kept", "review")).select("id", F.size("soft").cast("long").alias("soft_count"), "score", "model")
    return r.orderBy(F.desc("soft_count"), "score", "id").limit(100)


@query(
    f"""WITH {_ROWS_SQL} SELECT split, route, model, count(*) AS pairs FROM routed GROUP BY GROUPING SETS ((split), (route), (model), (split, route), ())"""
)
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by split, by route, by model, by both first, and in all: one pass with grouping sets."""
    r = routed(_pairs(spark, sf))
    c = F.col
    return r.groupingSets([[c("split")], [c("route")], [c("model")], [c("split"), c("route")], []], c("split"), c("route"), c("model")).agg(F.count("*").alias("pairs"))


_LEAK_SQL = f"""{SQL["line_pairs"]}, k AS (SELECT id, m, key, CASE WHEN {t.sql_bucket("sha1(id::VARCHAR)")} < 80 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT id, unnest(['pair', 'source', 'target']) AS m, unnest([{t.sql_pair_key("source_text", "target_text")}, {t.sql_family_key("source_text")}, sha1({t.sql_word("target_text")})]) AS key FROM line_pairs))"""


@query(
    f"""WITH {_LEAK_SQL} SELECT m AS side, count(DISTINCT key) AS leaking_keys, sum(n)::BIGINT AS leaking_rows FROM (
  SELECT m, key, count(*) AS n FROM k GROUP BY m, key HAVING count(DISTINCT split) > 1) GROUP BY m"""
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a careless split (by row) puts on both sides: by pair, source and target."""
    s, g = F.col("source_text"), F.col("target_text")
    split = F.when(t.bucket(F.sha1(F.col("id").cast("string"))) < 80, "train").otherwise("test")
    sides = F.array(
        F.struct(F.lit("pair").alias("side"), t.pair_key(s, g).alias("key")),
        F.struct(F.lit("source").alias("side"), t.family_key(s).alias("key")),
        F.struct(F.lit("target").alias("side"), F.sha1(t.normalize_word(g)).alias("key")),
    )
    k = _pairs(spark, sf).select(split.alias("split"), F.explode(sides).alias("x")).select("split", "x.side", "x.key")
    per = k.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return per.groupBy("side").agg(F.count("*").alias("leaking_keys"), F.sum("n").alias("leaking_rows"))


@query(
    """SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.1"""
)
def fraction_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the documents by hash of their key: the sampling operator."""
    return table(spark, sf, "documents").where(t.fraction_of(F.col("doc_id").cast("string")) < 0.1).select("doc_id")


@query(
    """SELECT source, doc_id, sha256('7' || chr(9) || doc_id) AS place FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('7' || chr(9) || doc_id), doc_id) <= 20"""
)
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty documents of each source by seeded hash order; Spark prunes each task to twenty before the shuffle."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.sha2(F.concat(F.lit("7\t"), F.col("doc_id").cast("string")), 256).alias("place"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("place", "doc_id"))
    return d.withColumn("nth", nth).where("nth <= 20").drop("nth")


@query(
    """SELECT page_id, regexp_matches(html, '(?i)<(?:script|style|iframe|object|embed|link|meta)\\b|</?[a-z][^>]{0,80}>') AS has_html,
  regexp_matches(html, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') AS has_control FROM pages"""
)
def html_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.col("html").rlike(q.HTML).alias("has_html"), F.col("html").rlike(q.CONTROL).alias("has_control"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^/@?#]+') AND NOT regexp_matches(url, '^https://[^/?#]*@')
  THEN 'https://' || lower(regexp_extract(url, '^https://([^/?#:]+)', 1))
    || CASE WHEN regexp_extract(url, '^https://[^/?#:]+:([0-9]+)', 1) NOT IN ('', '443') THEN ':' || regexp_extract(url, '^https://[^/?#:]+:([0-9]+)', 1) ELSE '' END
    || regexp_extract(url, '^https://[^/?#]+([^#]*)', 1) END AS url FROM pages"""
)
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """https links without credentials and fragment, host in lower case, port kept unless it is 443; others null."""
    u = F.col("url")
    port = F.regexp_extract(u, r"^https://[^/?#:]+:([0-9]+)", 1)
    made = F.concat(
        F.lit("https://"), F.lower(F.regexp_extract(u, r"^https://([^/?#:]+)", 1)),
        F.when(~port.isin("", "443"), F.concat(F.lit(":"), port)).otherwise(""), F.regexp_extract(u, r"^https://[^/?#]+([^#]*)", 1),
    )
    return table(spark, sf, "pages").select("page_id", F.when(u.rlike(r"^https://[^/@?#]+") & ~u.rlike(r"^https://[^/?#]*@"), made).alias("url"))
