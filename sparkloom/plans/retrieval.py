"""Dictionary and sentence retrieval, completion, reference lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.search import bm25, exact_forms, tiered, tokens, top
from ..sources.views import SQL, lines, table, verses
from .registry import query

ASKED = ("bolt", "red", "small ring", "gizm", "old")
_ASKED_SQL = "asked AS (SELECT unnest(['bolt', 'red', 'small ring', 'gizm', 'old']) AS query)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionary entries: headword, definition, domain, tier."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("headword"), F.col("p_type").alias("definition"), F.col("p_brand").alias("domain"), F.col("p_size").alias("tier")
    )


_CASCADE_SQL = f"""{_ASKED_SQL}, m AS (SELECT query, p_partkey AS id, p_name AS headword, p_size AS tier,
  CASE WHEN p_name = query THEN 0 WHEN starts_with(p_name, query) THEN 1 WHEN list_contains(string_split(p_name, ' '), query) THEN 2 WHEN contains(p_name, query) THEN 3 END AS level FROM part, asked)"""


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    # A handful of query strings: a literal array, no join.
    e = _entries(spark, sf).withColumn("query", F.explode(F.array(*[F.lit(x) for x in ASKED])))
    return e.withColumn("level", tiered(e, "id", F.col("headword"), F.col("query"))).where(F.col("level").isNotNull())


@query(
    f"""WITH {_CASCADE_SQL} SELECT query, id, level, row_number() OVER (PARTITION BY query ORDER BY level, length(headword), tier, id) AS place
FROM m WHERE level IS NOT NULL QUALIFY place <= 100"""
)
def dictionary_search(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred entries a query: exact, then prefix, whole word, substring; shorter and lower tiers first."""
    return top(_cascade(spark, sf), "query", ["level", F.char_length("headword"), "tier", "id"], 100).select("query", "id", "level", "place")


@query(
    f"""WITH {_ASKED_SQL} SELECT query, p_name AS headword, count(*) AS entries FROM part, asked WHERE starts_with(p_name, query) GROUP BY query, p_name
QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(p_name), p_name) <= 20"""
)
def dictionary_suggest(spark: SparkSession, sf: str) -> DataFrame:
    e = _entries(spark, sf).withColumn("query", F.explode(F.array(*[F.lit(x) for x in ASKED]))).where(F.col("headword").startswith(F.col("query")))
    g = e.groupBy("query", "headword").agg(F.count("*").alias("entries"))
    return top(g, "query", [F.char_length("headword"), "headword"], 20).drop("place")


@query("SELECT upper(left(p_name, 1)) AS letter, count(*) AS entries FROM part WHERE p_name <> '' GROUP BY ALL")
def letter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).where("headword <> ''").groupBy(F.upper(F.substring("headword", 1, 1)).alias("letter")).agg(F.count("*").alias("entries"))


@query("SELECT count(*) AS entries, count(DISTINCT p_name) AS headwords, count(*) FILTER (p_size <= 10) AS basic, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part")
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").agg(
        F.count("*").alias("entries"), F.countDistinct("p_name").alias("headwords"), F.count_if(F.col("p_size") <= 10).alias("basic"),
        F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"),
    )


@query("SELECT p_partkey AS id, p_name AS headword FROM part WHERE p_size <= 10 ORDER BY p_partkey LIMIT 1 OFFSET (SELECT 20261119 % count(*) FROM part WHERE p_size <= 10)")
def word_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """The entry at place seed modulo count, in id order: counted, then taken by offset."""
    e = _entries(spark, sf).where("tier <= 10").select("id", "headword")
    n = e.count()
    return e.orderBy("id").offset(20261119 % max(1, n)).limit(1)


@query(
    f"""WITH {SQL["lines"]}, q AS (SELECT item_id AS query, unnest(list_distinct(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)))) AS term FROM benchmark),
ix AS (SELECT key, term, length, count(*) AS tf FROM (SELECT doc_id AS key, unnest(w) AS term, len(w) AS length FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)) AS w FROM documents)) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT key, length FROM ix)),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
s AS (SELECT query, key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM q JOIN ix USING (term) JOIN df USING (term), st GROUP BY query, key)
SELECT query, key AS doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM s QUALIFY place <= 10"""
)
def pair_search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item by BM25."""
    index = _docs(spark, sf).select("doc_id", t.words(F.col("text")).alias("words")).withColumn("length", F.size("words"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.explode(F.array_distinct(F.transform(t.words(F.col("text")), F.lower))).alias("term"))
    scored = bm25(index, "doc_id", asked).select("query", "doc_id", F.round("score", 6).alias("score"))
    return top(scored, "query", [F.desc("score"), "doc_id"], 10)


@query(
    f"""WITH {SQL["lines"]}, l AS (SELECT doc_id, line_no, {t.sql_word("line")} AS k FROM lines), b AS (SELECT DISTINCT item_id, {t.sql_word("line")} AS k FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> '')
SELECT item_id, arg_min(doc_id, (doc_id, line_no)) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no, count(*) AS found FROM b JOIN l USING (k) WHERE k <> '' GROUP BY item_id"""
)
def retrieval_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The first exactly matching line for each item: a retrieval answer for every query at once."""
    l = lines(_docs(spark, sf)).select("doc_id", F.col("line_no").cast("long"), t.normalize_word(F.col("line")).alias("k"))
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.trim("line") != "")
    b = b.select("item_id", t.normalize_word(F.col("line")).alias("k")).where("k <> ''").distinct()
    j = l.join(b, "k").groupBy("item_id").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("found"))
    return j.select("item_id", "at.doc_id", "at.line_no", "found")


@query(
    f"""WITH {SQL["verses"]} SELECT version, book, chapter, verse FROM verses
WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'from')"""
)
def and_like_search(spark: SparkSession, sf: str) -> DataFrame:
    """Verses that hold every term of a search, as substrings, ignoring case."""
    low = F.lower("text")
    found = F.contains(low, F.lit("the")) & F.contains(low, F.lit("and")) & F.contains(low, F.lit("from"))
    return verses(_docs(spark, sf)).where(found).select("version", "book", "chapter", "verse")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'of the') OR contains(source, 'of the')")
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a phrase in any of several columns."""
    return _docs(spark, sf).where(F.contains("text", F.lit("of the")) | F.contains("source", F.lit("of the"))).select("doc_id", "source")


@query(f"""WITH {SQL["lines"]} SELECT doc_id, line_no FROM lines WHERE lower(trim(line)) IN ('the', 'the.', 'the!', 'the?')""")
def exact_form_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines equal to a text or to it with a closing mark."""
    return lines(_docs(spark, sf)).where(F.lower(F.trim("line")).isin(exact_forms("The."))).select("doc_id", F.col("line_no").cast("long"))


_WORDS_SQL = """w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS form FROM documents),
f AS (SELECT lower(form) AS key, form, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT key, sum(n)::BIGINT AS uses, arg_min(form, (-n, form)) AS form FROM f GROUP BY key)"""


def word_list_of(docs: DataFrame) -> DataFrame:
    """key, uses, form: each lower-case word with its count and most common written form. Two aggregations, both combined early."""
    f = docs.select(F.explode(t.words(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return f.groupBy(F.lower("form").alias("key")).agg(F.sum("n").alias("uses"), F.min(F.struct(-F.col("n"), F.col("form").alias("form")))["form"].alias("form"))


@query(f"WITH {_WORDS_SQL} SELECT key, uses, form FROM k WHERE uses >= 3")
def word_list(spark: SparkSession, sf: str) -> DataFrame:
    return word_list_of(_docs(spark, sf)).where("uses >= 3")


@query(
    f"""WITH {_WORDS_SQL}, a AS (SELECT unnest(['th', 'on', 'er', 'qu', 'ein']) AS prefix)
SELECT prefix, form, uses, row_number() OVER (PARTITION BY prefix ORDER BY uses DESC, key) AS place FROM k JOIN a ON starts_with(key, prefix) QUALIFY place <= 10"""
)
def word_completion(spark: SparkSession, sf: str) -> DataFrame:
    """The ten commonest completions of each prefix."""
    w = word_list_of(_docs(spark, sf)).withColumn("prefix", F.explode(F.array(*[F.lit(p) for p in ("th", "on", "er", "qu", "ein")])))
    return top(w.where(F.col("key").startswith(F.col("prefix"))), "prefix", [F.desc("uses"), "key"], 10).select("prefix", "form", "uses", "place")


@query(f"""SELECT doc_id, regexp_extract(text, '([A-Za-z]+(?:[''’-][A-Za-z]*)*)$', 1) AS trailing FROM documents WHERE length(regexp_extract(text, '([A-Za-z]+(?:[''’-][A-Za-z]*)*)$', 1)) >= 2""")
def trailing_words(spark: SparkSession, sf: str) -> DataFrame:
    """The last word of a text that could be completed."""
    w = F.regexp_extract("text", "([A-Za-z]+(?:['’-][A-Za-z]*)*)\\z", 1)
    return _docs(spark, sf).select("doc_id", w.alias("trailing")).where(F.char_length("trailing") >= 2)


@query(
    f"""WITH {SQL["verses"]} SELECT z.version AS other, e.book, e.chapter, e.verse, z.doc_id AS other_id, e.doc_id AS en_id
FROM verses z JOIN verses e ON e.version = 'en' AND z.version <> 'en' AND z.book = e.book AND z.chapter = e.chapter AND z.verse = e.verse"""
)
def verse_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every other version's verses with the English ones of the same place."""
    v = verses(_docs(spark, sf)).drop("text")
    e = v.where("version = 'en'").select("book", "chapter", "verse", F.col("doc_id").alias("en_id"))
    z = v.where("version <> 'en'").select(F.col("version").alias("other"), "book", "chapter", "verse", F.col("doc_id").alias("other_id"))
    return z.join(e, ["book", "chapter", "verse"]).select("other", "book", "chapter", "verse", "other_id", "en_id")


@query(
    f"""WITH {SQL["verses"]} SELECT e.book, count(*) AS unpaired FROM verses e WHERE e.version = 'en'
AND NOT EXISTS (SELECT 1 FROM verses z WHERE z.version = 'fr' AND z.book = e.book AND z.chapter = e.chapter AND z.verse = e.verse) GROUP BY e.book"""
)
def unpaired_verses(spark: SparkSession, sf: str) -> DataFrame:
    v = verses(_docs(spark, sf)).select("version", "book", "chapter", "verse")
    e, z = v.where("version = 'en'"), v.where("version = 'fr'").drop("version")
    return e.join(z, ["book", "chapter", "verse"], "left_anti").groupBy("book").agg(F.count("*").alias("unpaired"))


@query(
    f"""WITH {SQL["verses"]}, c AS (SELECT DISTINCT version, book, chapter FROM verses)
SELECT version, book, chapter, coalesce(lag(book) OVER w, -1) AS prev_book, coalesce(lag(chapter) OVER w, -1) AS prev_chapter, coalesce(lead(book) OVER w, -1) AS next_book, coalesce(lead(chapter) OVER w, -1) AS next_chapter
FROM c WINDOW w AS (PARTITION BY version ORDER BY book, chapter)"""
)
def adjacent_units(spark: SparkSession, sf: str) -> DataFrame:
    """Each chapter's neighbours, across books (-1 where there is none); chapters, not verses, are in the window."""
    c = verses(_docs(spark, sf)).select("version", "book", "chapter").distinct()
    w = Window.partitionBy("version").orderBy("book", "chapter")
    return c.select(
        "version", "book", "chapter",
        *[F.coalesce(f(c).over(w), F.lit(-1)).alias(f"{side}_{c}") for f, side in ((F.lag, "prev"), (F.lead, "next")) for c in ("book", "chapter")],
    )


@query(
    f"""WITH {SQL["verses"]} SELECT version, book, array_to_string(list_sort(list(DISTINCT chapter)), ',') AS chapters, count(*) AS verses FROM verses GROUP BY version, book"""
)
def book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    g = verses(_docs(spark, sf)).groupBy("version", "book").agg(F.sort_array(F.collect_set("chapter")).alias("c"), F.count("*").alias("verses"))
    return g.select("version", "book", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("chapters"), "verses")


_SPAN_SQL = f"""{SQL["verses"]}, s AS (SELECT version, book, chapter, verse AS lo, verse + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS hi FROM verses WHERE version IN ('en', 'fr')),
g AS (SELECT *, CASE WHEN lo > coalesce(max(hi) OVER (PARTITION BY book, chapter ORDER BY lo, hi, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY book, chapter ORDER BY lo, hi, version) AS island FROM g)"""


@query(
    f"""WITH {_SPAN_SQL} SELECT book, chapter, min(lo) AS first, max(hi) AS last, count(*) FILTER (version = 'en') AS primary_spans, count(*) FILTER (version = 'fr') AS secondary_spans FROM i GROUP BY book, chapter, island"""
)
def align_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions' verse spans merged where they overlap: islands by a running end."""
    v = verses(_docs(spark, sf)).where(F.col("version").isin("en", "fr"))
    s = v.select("version", "book", "chapter", F.col("verse").alias("lo"), (F.col("verse") + F.when(F.pmod("doc_id", F.lit(7)) == 0, 1).otherwise(0)).alias("hi"))
    w = Window.partitionBy("book", "chapter").orderBy("lo", "hi", "version")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = s.withColumn("fresh", (F.col("lo") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("book", "chapter", "island").agg(
        F.min("lo").alias("first"), F.max("hi").alias("last"), F.count_if(F.col("version") == "en").alias("primary_spans"), F.count_if(F.col("version") == "fr").alias("secondary_spans")
    ).drop("island")


@query(
    """WITH a AS (SELECT 'dictionary' AS store, p_partkey AS id, p_name AS text, p_name = 'red bolt' AS exact FROM part WHERE contains(p_name, 'red bolt')),
b AS (SELECT 'corpus' AS store, doc_id AS id, text, false AS exact FROM documents WHERE contains(text, 'red bolt') OR contains(text, 'than that'))
SELECT store, id, exact, row_number() OVER (ORDER BY NOT exact, store DESC, length(text), id) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY place <= 50"""
)
def unified_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two stores' matches in one ranking, fifty of them: exact first, dictionary before corpus, shorter first."""
    a = table(spark, sf, "part").where(F.contains("p_name", F.lit("red bolt"))).select(
        F.lit("dictionary").alias("store"), F.col("p_partkey").alias("id"), F.char_length("p_name").alias("n"), (F.col("p_name") == "red bolt").alias("exact")
    )
    b = _docs(spark, sf).where(F.contains("text", F.lit("red bolt")) | F.contains("text", F.lit("than that"))).select(
        F.lit("corpus").alias("store"), F.col("doc_id").alias("id"), F.char_length("text").alias("n"), F.lit(False).alias("exact")
    )
    best = a.unionByName(b).orderBy(~F.col("exact"), F.desc("store"), "n", "id").limit(50)
    nth = F.row_number().over(Window.orderBy(~F.col("exact"), F.desc("store"), "n", "id"))
    return best.select("store", "id", "exact", nth.cast("long").alias("place"))
