"""Tiered retrieval: dictionary cascade both ways, sentence pairs by tiers, retrieval answers; templates with learned names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as q
from ..functions import text as t
from ..operators.lineage import checkpointed
from ..operators.search import B, K1, covering, exact_forms, term_weights, top
from ..sources.views import SQL, line_pairs, lines, table, turn_pairs
from .corpus import learned
from .registry import query

#: What is looked up: by headword, and by meaning.
BY_HEADWORD, BY_MEANING = ("bolt", "red", "small bo", "old widget"), ("promo", "standard", "brand#1", "omo")
LIMIT = 50


def _literal(values: tuple[str, ...]) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _words_match(text: Column, query: Column) -> Column:
    """All terms of a query are words of the text, the last as a beginning."""
    words, terms = F.split(text, " "), F.split(query, " ")
    whole = F.slice(terms, F.lit(1), F.size(terms) - 1)
    last = F.element_at(terms, -1)
    return (F.size(F.array_except(whole, words)) == 0) & F.exists(words, lambda w: w.startswith(last))


def cascade(entries: DataFrame, n: int = LIMIT) -> DataFrame:
    """query, direction, id, level, place: entries by headword or by meaning, the closest way of matching first.

    ``entries``: id, headword, meanings (alternatives parted by ' ; '), flagged,
    confidence, tier. By headword: 0 equal, 1 beginning (short ones first), 2
    all words. By meaning: 0 equal to it or to an alternative (its own, then
    lower tiers first), 1 all words; what has neither is searched as a
    substring, 2. An entry keeps its first level; flagged ones come later in it.
    """
    low = entries.withColumns({"h": F.lower("headword"), "m": F.lower("meanings")})
    asked = low.withColumn("query", _literal(BY_HEADWORD))
    head = (
        F.when(F.col("h") == F.col("query"), 0).when(F.col("h").startswith(F.col("query")), 1)
        .when(_words_match(F.col("h"), F.col("query")), 2)
    )
    size = F.when(F.col("level") == 1, F.char_length("headword")).otherwise(0)
    sure = F.when(F.col("level") == 2, -F.col("confidence")).otherwise(F.lit(0.0))
    zero = F.lit(0)
    by_head = asked.withColumn("level", head).where("level IS NOT NULL").select(
        F.lit("headword").alias("direction"), "query", "id", "level", size.alias("k1"), "flagged", zero.alias("k2"), zero.alias("k3"), sure.alias("k4"), F.lit("").alias("k5")
    )
    sought = low.withColumn("query", _literal(BY_MEANING))
    own = F.col("m") == F.col("query")
    alternative = F.contains(F.concat(F.lit(" ; "), "m", F.lit(" ; ")), F.concat(F.lit(" ; "), "query", F.lit(" ; ")))
    flat = F.replace(F.col("m"), F.lit(" ; "), F.lit(" "))
    close = F.when(alternative, 0).when(_words_match(flat, F.col("query")), 1)
    near = sought.withColumn("level", F.coalesce(close, F.when(F.contains("m", F.col("query")), 2))).where("level IS NOT NULL")
    # A substring counts only where nothing closer is found.
    best = near.groupBy("query").agg(F.min("level").alias("best"))
    near = near.join(F.broadcast(best), "query").where("level < 2 OR best = 2")
    exact = F.col("level") == 0
    by_meaning = near.select(
        F.lit("meaning").alias("direction"), "query", "id", "level", zero.alias("k1"), "flagged", F.when(exact & ~own, 1).otherwise(0).alias("k2"),
        F.when(exact, F.col("tier") * 1000 + F.char_length("headword")).otherwise(0).alias("k3"), F.when(F.col("level") == 1, -F.col("confidence")).otherwise(F.lit(0.0)).alias("k4"),
        F.when(F.col("level") == 2, F.lower("headword")).otherwise("").alias("k5"),
    )
    both = by_head.unionByName(by_meaning).withColumn("asked", F.concat_ws(":", "direction", "query"))
    return top(both, "asked", ["level", "k1", "flagged", "k2", "k3", "k4", "k5", "id"], n).select("direction", "query", "id", "level", "place")


_MATCH = lambda x: f"len(list_filter(string_split(query, ' ')[:-2], lambda w: NOT list_contains(string_split({x}, ' '), w))) = 0 AND list_bool_or(list_transform(string_split({x}, ' '), lambda w: starts_with(w, string_split(query, ' ')[-1])))"


@query(
    f"""WITH e AS (SELECT p_partkey AS id, p_name AS headword, lower(p_name) AS h, lower(p_type || ' ; ' || p_brand) AS m, p_size % 7 = 0 AS flagged, p_retailprice AS confidence, (p_size % 6)::INT AS tier FROM part),
hq AS (SELECT e.*, query, CASE WHEN h = query THEN 0 WHEN starts_with(h, query) THEN 1 WHEN {_MATCH("h")} THEN 2 END AS level FROM e, (SELECT unnest({list(BY_HEADWORD)}) AS query)),
mq AS (SELECT e.*, query, CASE WHEN contains(' ; ' || m || ' ; ', ' ; ' || query || ' ; ') THEN 0 WHEN {_MATCH("replace(m, ' ; ', ' ')")} THEN 1 WHEN contains(m, query) THEN 2 END AS level FROM e, (SELECT unnest({list(BY_MEANING)}) AS query)),
mb AS (SELECT *, min(level) OVER (PARTITION BY query) AS best FROM mq WHERE level IS NOT NULL)
SELECT 'headword' AS direction, query, id, level, row_number() OVER (PARTITION BY query ORDER BY level, CASE WHEN level = 1 THEN length(headword) ELSE 0 END, flagged, CASE WHEN level = 2 THEN -confidence ELSE 0 END, id) AS place FROM hq WHERE level IS NOT NULL QUALIFY place <= {LIMIT}
UNION ALL
SELECT 'meaning', query, id, level, row_number() OVER (PARTITION BY query ORDER BY level, flagged, CASE WHEN level = 0 AND m <> query THEN 1 ELSE 0 END, CASE WHEN level = 0 THEN tier * 1000 + length(headword) ELSE 0 END, CASE WHEN level = 1 THEN -confidence ELSE 0 END, CASE WHEN level = 2 THEN lower(headword) ELSE '' END, id) AS place
FROM mb WHERE level < 2 OR best = 2 QUALIFY place <= {LIMIT}"""
)
def dictionary_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty entries a query by the cascade, by headword and by meaning. Queries are a literal array: no join."""
    entries = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.concat("p_type", F.lit(" ; "), "p_brand").alias("meanings"),
        (F.col("p_size") % 7 == 0).alias("flagged"), F.col("p_retailprice").alias("confidence"), (F.col("p_size") % 6).alias("tier"),
    )
    return cascade(entries)


#: Sentence queries; the last word of each is a beginning.
SENTENCES = ("in the", "the th", "is it an", "and", "rébl", "das ge")


def _folded(c: Column) -> Column:
    return t.fold_marks(F.lower(c))


def pair_tiers(pairs: DataFrame, queries: tuple[str, ...], n: int = LIMIT) -> DataFrame:
    """query, id, exact, place: pairs whose source is a form of the query first, by score; then those that hold all its words.

    ``pairs``: id, source_text, score. Words are compared without case and
    marks, the last word of a query as a beginning; pairs under a score of 0.5
    are shown only if exact; the shortest sources come first, then the best by
    BM25, whose prefix term counts every word that begins so.
    """
    terms = [[w for w in _plain(x).split()] for x in queries]
    rows = pairs.select("id", "source_text", "score", t.words(_folded(F.col("source_text"))).alias("w"))
    counts = []
    for ts in terms:
        counts.append(F.array(*[_times(x, i == len(ts) - 1) for i, x in enumerate(ts)]))
    made = F.array(*[
        F.struct(F.lit(x).alias("query"), F.lower(F.trim("source_text")).isin(exact_forms(x)).alias("exact"), c.alias("tf")) for x, c in zip(queries, counts)
    ])
    # Only rows that hold some term of a query leave the scan, without their texts.
    each = rows.select("id", "score", F.size("w").alias("length"), F.char_length("source_text").alias("size"), F.explode(made).alias("m")).select("id", "score", "length", "size", "m.*")
    hit = checkpointed(each.where(F.col("exact") | F.exists("tf", lambda x: x > 0)))
    stats = rows.where(F.size("w") > 0).agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    df = hit.select("query", F.posexplode("tf").alias("i", "x")).where("x > 0").groupBy("query", "i").agg(F.count("*").alias("df"))
    listed = df.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("i", "df"))).alias("df"))
    met = hit.where(F.col("exact") | ((F.col("score") >= 0.5) & F.forall("tf", lambda x: x > 0)))
    scored = met.join(F.broadcast(listed), "query").crossJoin(F.broadcast(stats))

    def weight(x: Column, i: Column) -> Column:
        d = F.coalesce(F.element_at("df", i), F.lit(0))
        return F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("length") / F.col("mean")))

    bm = F.aggregate(F.transform("tf", weight), F.lit(0.0), lambda a, x: a + x)
    ranked = scored.withColumns({
        "later": (~F.col("exact")).cast("int"), "k1": F.when(F.col("exact"), -F.col("score")).otherwise(F.col("size")), "k2": F.when(F.col("exact"), F.lit(0.0)).otherwise(-F.round(bm, 6)),
    })
    return top(ranked, "query", ["later", "k1", "k2", "id"], n).select("query", "id", "exact", "place")


def _times(term: str, beginning: bool) -> Column:
    return F.size(F.filter("w", lambda w: w.startswith(term) if beginning else w == F.lit(term)))


def _plain(text: str) -> str:
    return text.lower().translate(str.maketrans(t.MARKED, t.PLAIN))


def _tf_sql(words: str) -> str:
    cases = []
    for x in SENTENCES:
        ts = _plain(x).split()
        tf = [f"len(list_filter({words}, lambda z: {'starts_with(z, ' + repr(w) + ')' if i == len(ts) - 1 else 'z = ' + repr(w)}))" for i, w in enumerate(ts)]
        forms = ", ".join(repr(f) for f in exact_forms(x))
        cases.append(f"{{'query': '{x}', 'exact': lower(trim(source_text)) IN ({forms}), 'tf': [{', '.join(tf)}]}}")
    return ", ".join(cases)


@query(
    f"""WITH {SQL["turn_pairs"]}, r AS (SELECT id, source_text, {q.sql_score("flags")} AS score, w FROM (SELECT id, source_text, {q.sql_flags("source_text", "target_text")} AS flags,
  {t.sql_words("translate(lower(source_text), '" + t.MARKED + "', '" + t.PLAIN + "')")} AS w FROM turn_pairs)),
e AS (SELECT id, score, len(w) AS length, length(source_text) AS size, m.query AS query, m.exact AS exact, m.tf AS tf FROM (SELECT *, unnest([{_tf_sql("w")}]) AS m FROM r)),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM r WHERE len(w) > 0),
d AS (SELECT query, i, count(*) AS df FROM (SELECT query, unnest(range(1, len(tf) + 1)) AS i, unnest(tf) AS x FROM e) WHERE x > 0 GROUP BY ALL),
x AS (SELECT e.query, e.id, exact, score, size, (SELECT 0) AS z, tf, length FROM e WHERE exact OR (score >= 0.5 AND list_bool_and(list_transform(tf, lambda v: v > 0)))),
b AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * v * 2.2::DOUBLE / (v + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS bm
  FROM (SELECT query, id, length, unnest(range(1, len(tf) + 1)) AS i, unnest(tf) AS v FROM x) JOIN d USING (query, i), st GROUP BY query, id)
SELECT query, id, exact, row_number() OVER (PARTITION BY query ORDER BY NOT exact, CASE WHEN exact THEN -score ELSE size END, CASE WHEN exact THEN 0 ELSE -round(bm, 6) END, id) AS place
FROM x JOIN b USING (query, id) QUALIFY place <= {LIMIT}"""
)
def pair_search_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty sentence pairs a query: exact forms, then all words, the shortest and best first."""
    pairs = turn_pairs(table(spark, sf, "conversations"))
    return pair_tiers(pairs.withColumn("score", q.quality_score(q.quality_flags(F.col("source_text"), F.col("target_text")))), SENTENCES)


@query(
    f"""WITH {SQL["line_pairs"]}, p AS (SELECT id, lower(trim(source_text)) AS exact_key, {t.sql_words("lower(source_text)")} AS w, {q.sql_score(q.sql_flags("source_text", "target_text"))} AS score FROM line_pairs WHERE {t.sql_split(t.sql_family_key("source_text"))} <> 'test'),
a AS (SELECT item_id * 100 + i AS query, lower(trim(parts[i])) AS exact_key, list_distinct({t.sql_words("lower(parts[i])")}) AS ws FROM (SELECT item_id, string_split(text, chr(10)) AS parts FROM benchmark), unnest(range(1, len(parts) + 1)) AS u(i) WHERE trim(parts[i]) <> ''),
ex AS (SELECT query, arg_min(id, (-score, id)) AS id FROM a JOIN p USING (exact_key) GROUP BY query),
ix AS (SELECT id, term, len(w) AS length, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM p WHERE score >= 0.5) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p WHERE score >= 0.5 AND len(w) > 0), df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
qt AS (SELECT query, unnest(ws) AS term, len(ws) AS k FROM a),
s AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS bm, count(*) AS met, any_value(k) AS k FROM qt JOIN ix USING (term) JOIN df USING (term), st GROUP BY query, id),
be AS (SELECT query, arg_min(s.id, (-bm, -score, s.id)) AS id FROM s JOIN p ON p.id = s.id WHERE met = k GROUP BY query)
SELECT a.query, coalesce(ex.id, be.id, -1) AS id, CASE WHEN ex.id IS NOT NULL THEN 'exact' WHEN be.id IS NOT NULL THEN 'words' ELSE 'none' END AS how FROM a LEFT JOIN ex USING (query) LEFT JOIN be USING (query)"""
)
def retrieval_answers(spark: SparkSession, sf: str) -> DataFrame:
    """For every line of the benchmark the pair that retrieval would answer with: the best equal one, else the best that
    holds all its words; pairs held out for tests are never an answer."""
    s, g = F.col("source_text"), F.col("target_text")
    served = line_pairs(table(spark, sf, "documents")).where(t.hash_split(t.family_key(s)) != "test")
    p = checkpointed(served.select("id", F.lower(s).alias("low"), q.quality_score(q.quality_flags(s, g)).alias("score")))
    items = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.trim("line") != "")
    asked = checkpointed(items.select((F.col("item_id") * 100 + F.col("i") + 1).alias("query"), F.trim(F.lower("line")).alias("exact_key"), F.array_distinct(t.words(F.lower("line"))).alias("ws")))
    keys = F.broadcast(asked.select("query", "exact_key"))
    equal = p.select("id", "score", F.trim("low").alias("exact_key")).join(keys, "exact_key").groupBy("query").agg(F.min(F.struct(-F.col("score"), "id")).alias("e")).select("query", F.col("e.id").alias("equal"))
    index = p.where("score >= 0.5").select("id", F.col("score").alias("worth"), t.words(F.col("low")).alias("words")).withColumn("length", F.size("words"))
    terms = asked.select("query", F.explode("ws").alias("term"))
    order = F.struct((-F.round("score", 6)).alias("bm"), (-F.col("worth")).alias("score"), "id")
    close = covering(index, "id", term_weights(index, terms), terms).groupBy("query").agg(F.min(order).alias("b")).select("query", F.col("b.id").alias("close"))
    how = F.when(F.col("equal").isNotNull(), "exact").when(F.col("close").isNotNull(), "words").otherwise("none")
    return asked.select("query").join(equal, "query", "left").join(close, "query", "left").select("query", F.coalesce("equal", "close", F.lit(-1)).alias("id"), how.alias("how"))


def named_templates(rows: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """``keys`` and template: the second pass, with learned names masked as well. ``names`` has (word).

    Only words that are names come back to a row, as the few names it has; the
    list of all names is joined, not carried along.
    """
    said = rows.select(*keys, F.explode(F.array_distinct(F.transform(t.words(F.col(text)), F.lower))).alias("word"))
    met = said.join(names.select("word"), "word").groupBy(*keys).agg(F.collect_set("word").alias("names"))
    joined = rows.select(*keys, text).join(met, keys, "left")
    none = F.array().cast("array<string>")
    plain, masked = t.template_key(F.col(text)), t.template_key(F.col(text), F.coalesce("names", none))
    return joined.select(*keys, F.when(F.col("names").isNull(), plain).otherwise(masked).alias("template"))


@query(
    f"""WITH {SQL["lines"]}, w AS (SELECT unnest({t.sql_words("line")}[2:]) AS w FROM lines),
n AS (SELECT lower(w) AS word FROM w WHERE length(w) >= 2 AND regexp_full_match(w, '\\p{{L}}+') GROUP BY 1
  HAVING count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) >= 5 AND count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) >= 0.9::DOUBLE * (count(*) FILTER (regexp_matches(w, '^\\p{{Lu}}')) + count(*) FILTER (NOT regexp_matches(w, '^\\p{{Lu}}') AND w = lower(w)))),
x AS (SELECT doc_id, line_no, {t.sql_masked("line")} AS ws FROM lines), u AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM x),
k AS (SELECT doc_id, line_no, sha1(string_agg(CASE WHEN n.word IS NULL THEN u.word ELSE '<name>' END, ' ' ORDER BY i)) AS template FROM u LEFT JOIN n USING (word) GROUP BY ALL)
SELECT x.doc_id, x.line_no, coalesce(template, sha1('')) AS template FROM x LEFT JOIN k USING (doc_id, line_no)"""
)
def template_keys_named(spark: SparkSession, sf: str) -> DataFrame:
    """The template of every line once names are known."""
    rows = lines(table(spark, sf, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    return named_templates(rows, ["doc_id", "line_no"], "line", checkpointed(learned(rows, "line")))
