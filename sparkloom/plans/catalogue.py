"""Dictionary maintenance: fields, senses, audits, mining, merging, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.numbering import numbered
from ..operators.search import top
from ..sources.views import SQL, table, verses
from .registry import query
from .retrieval import ASKED, _ASKED_SQL, _CASCADE_SQL, _cascade

#: Longest version slug.
SLUG = 32


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens between, at most SLUG characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-")), 1, SLUG)


def normalize_pos(c: Column) -> Column:
    """Lower case without dots, the first of its pieces."""
    return F.trim(F.get(F.split(F.regexp_replace(F.lower(c), r"\.", ""), "[;,/ ]"), F.lit(0)))


@query(
    """SELECT p_partkey AS id, split_part(lower(replace(p_type, '.', '')), ' ', 1) AS pos, CASE WHEN regexp_matches(p_name, '^[A-Z]') THEN 'name' WHEN contains(p_name, ' ') THEN 'phrase' ELSE 'word' END AS entry_type,
  left(trim(regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 32) AS slug, split_part(p_name, ' ', 1) AS gloss, trim(substr(p_name, length(split_part(p_name, ' ', 1)) + 1)) AS rest FROM part"""
)
def entry_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Part of speech, type, slug, gloss and rest of every entry."""
    name = F.col("p_name")
    first = F.substring_index(name, " ", 1)
    kind = F.when(name.rlike("^[A-Z]"), "name").when(F.contains(name, F.lit(" ")), "phrase").otherwise("word")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), normalize_pos(F.col("p_type")).alias("pos"), kind.alias("entry_type"), slug(F.concat_ws("_", "p_name", "p_brand")).alias("slug"),
        first.alias("gloss"), F.trim(F.substr(name, F.char_length(first) + 1)).alias("rest"),
    )


@query(
    """SELECT p_name AS headword, array_to_string(list_sort(list(DISTINCT p_type)), '; ') AS equivalents, arg_min(p_brand, p_partkey) AS first_example, count(DISTINCT p_brand) AS sources,
  array_to_string(list_sort(list(DISTINCT CASE WHEN p_size > 40 THEN 'large' WHEN p_size < 5 THEN 'small' END) FILTER (p_size > 40 OR p_size < 5)), ',') AS issues FROM part GROUP BY p_name"""
)
def sense_details(spark: SparkSession, sf: str) -> DataFrame:
    """A headword's equivalents, first example, number of sources and open issues: one aggregation for what were subqueries."""
    g = table(spark, sf, "part").groupBy(F.col("p_name").alias("headword")).agg(
        F.array_sort(F.collect_set("p_type")).alias("e"), F.min_by("p_brand", "p_partkey").alias("first_example"), F.countDistinct("p_brand").alias("sources"),
        F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, "large").when(F.col("p_size") < 5, "small"))).alias("i"),
    )
    issues = F.when(F.size("i") > 0, F.array_join("i", ","))
    return g.select("headword", F.array_join("e", "; ").alias("equivalents"), "first_example", "sources", issues.alias("issues"))


@query(
    """SELECT 'duplicate_headword' AS kind, p_name || '/' || p_type AS subject, count(*) AS n FROM part GROUP BY p_name, p_type HAVING count(*) > 1
UNION ALL SELECT 'many_senses', p_name, count(DISTINCT p_type) FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 5
UNION ALL SELECT 'missing_field', p_partkey::VARCHAR, 1 FROM part WHERE trim(coalesce(p_type, '')) = '' OR trim(coalesce(p_name, '')) = ''"""
)
def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    twice = p.groupBy("p_name", "p_type").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_headword").alias("kind"), F.concat_ws("/", "p_name", "p_type").alias("subject"), "n")
    many = p.groupBy("p_name").agg(F.countDistinct("p_type").alias("n")).where("n > 5").select(F.lit("many_senses").alias("kind"), F.col("p_name").alias("subject"), "n")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    missing = p.where(blank("p_type") | blank("p_name")).select(F.lit("missing_field").alias("kind"), F.col("p_partkey").cast("string").alias("subject"), F.lit(1).cast("long").alias("n"))
    return twice.unionByName(many).unionByName(missing)


@query(
    """SELECT kind, substr(sha1('{"kind":"' || kind || '","subject":"' || subject || '"}'), 1, 12) AS finding_id FROM (
  SELECT 'duplicate_headword' AS kind, p_name || '/' || p_type AS subject FROM part GROUP BY p_name, p_type HAVING count(*) > 1
  UNION ALL SELECT 'many_senses', p_name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 5
  UNION ALL SELECT 'missing_field', p_partkey::VARCHAR FROM part WHERE trim(coalesce(p_type, '')) = '' OR trim(coalesce(p_name, '')) = '')"""
)
def finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Content ids: twelve digits of the hash of a finding's canonical JSON."""
    whole = F.to_json(F.struct("kind", "subject"))
    return audit_findings(spark, sf).select("kind", F.substring(F.sha1(whole), 1, 12).alias("finding_id"))


@query(
    """WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))) AS form, doc_id, source FROM documents),
f AS (SELECT form, count(*) AS docs, count(DISTINCT source) AS sources FROM w GROUP BY form HAVING count(*) >= 20),
k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part)
SELECT form, docs, sources, (SELECT array_to_string(list(doc_id ORDER BY doc_id)[1:3], ',') FROM w WHERE w.form = f.form) AS evidence FROM f WHERE form NOT IN (SELECT form FROM k)"""
)
def mined_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of twenty documents or more that the dictionary lacks, with three documents as evidence.

    Each task keeps three rows a word for the evidence, so no word gathers its documents.
    """
    d = table(spark, sf, "documents")
    w = d.select("doc_id", "source", F.explode(F.array_distinct(F.transform(t.words(F.col("text")), F.lower))).alias("form"))
    f = w.groupBy("form").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources")).where("docs >= 20")
    known = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("form")).distinct()
    nth = F.row_number().over(Window.partitionBy("form").orderBy("doc_id"))
    seen = w.select("form", "doc_id", nth.alias("nth")).where("nth <= 3").groupBy("form").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("evidence"))
    return f.join(known, "form", "left_anti").join(seen, "form").select("form", "docs", "sources", "evidence")


@query(
    """WITH old AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part WHERE p_size <= 25),
fresh AS (SELECT lower(trim(p_name)) AS a, lower(trim(p_type)) AS b, min(p_partkey) AS first FROM part WHERE p_size > 25 GROUP BY ALL)
SELECT (SELECT max(p_partkey) FROM old) + row_number() OVER (ORDER BY first) AS new_id, a AS headword, b AS definition FROM fresh WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.a = fresh.a AND old.b = fresh.b)"""
)
def merge_entries(spark: SparkSession, sf: str) -> DataFrame:
    """New entries that aren't there yet, with ids that go on from the greatest."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.lower(F.trim("p_name")).alias("headword"), F.lower(F.trim("p_type")).alias("definition"))
    old = p.where("p_size <= 25")
    fresh = p.where("p_size > 25").groupBy("headword", "definition").agg(F.min("p_partkey").alias("first")).join(old, ["headword", "definition"], "left_anti")
    last = old.agg(F.coalesce(F.max("p_partkey"), F.lit(0)).alias("last"))
    return numbered(fresh, "first").crossJoin(F.broadcast(last)).select((F.col("last") + F.col("nth")).alias("new_id"), "headword", "definition")


@query(
    """WITH s AS (SELECT p_name, count(DISTINCT p_brand) AS sources FROM part GROUP BY p_name)
SELECT p_partkey AS id, sources, p_name AS headword FROM part JOIN s USING (p_name) WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND p_partkey NOT IN (SELECT doc_id FROM labels)
ORDER BY sources DESC, p_size, p_name, p_partkey LIMIT 200"""
)
def review_export(spark: SparkSession, sf: str) -> DataFrame:
    """The next 200 entries to review: most sources first; what is taken or reviewed is skipped."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    s = p.groupBy("p_name").agg(F.countDistinct("p_brand").alias("sources"))
    taken = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("p_partkey"))
    left = p.drop("p_brand").join(taken, "p_partkey", "left_anti").join(done, "p_partkey", "left_anti").join(s, "p_name")
    return left.orderBy(F.desc("sources"), "p_size", "p_name", "p_partkey").limit(200).select(F.col("p_partkey").alias("id"), "sources", F.col("p_name").alias("headword"))


@query(
    """SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
)
def example_records(spark: SparkSession, sf: str) -> DataFrame:
    """Three tables by foreign keys: example, sense, entry. Sizes decide what is broadcast."""
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("SELECT DISTINCT n_name, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey OR c_custkey = n_nationkey")
def either_key(spark: SparkSession, sf: str) -> DataFrame:
    """A join on one key or another: two equi joins and their union, so no rows are compared all with all."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    by = [n.join(c, n["n_nationkey"] == c[k]).select("n_name", "c_custkey") for k in ("c_nationkey", "c_custkey")]
    return by[0].unionByName(by[1]).distinct()


@query("SELECT r_name AS category, array_to_string(list(n_name ORDER BY n_name), ', ') AS members, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def learning_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The curriculum's items by category; a category is a handful of items."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    g = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.coalesce("r_name", F.lit("General")).alias("category"))
    return g.agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"), F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(strip_accents(lower(n_name)), 'an')")
def filter_books(spark: SparkSession, sf: str) -> DataFrame:
    """Names that hold a text, whatever its case and accents: a collation decides."""
    n = table(spark, sf, "nation")
    return n.where(F.contains(F.collate("n_name", "UNICODE_CI_AI"), F.collate(F.lit("ÁN"), "UNICODE_CI_AI"))).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


# Words that carry no lookup.
STOPWORDS = ("the", "a", "an", "of", "to", "is", "what", "in", "for", "and", "how", "do", "you", "say", "mean")


@query(
    f"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w)), lambda w: w NOT IN ({", ".join(repr(w) for w in STOPWORDS)})), ' ') AS lookup,
  CASE WHEN regexp_matches(lower(text), 'mean|define') THEN 'define' WHEN regexp_matches(lower(text), 'translate|say') THEN 'translate' ELSE 'search' END AS intent FROM benchmark"""
)
def lookup_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What a question asks for, without stop words, and its intent by keyword."""
    low = F.lower("text")
    kept = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda w: ~w.isin(*STOPWORDS))
    intent = F.when(low.rlike("mean|define"), "define").when(low.rlike("translate|say"), "translate").otherwise("search")
    return table(spark, sf, "benchmark").select("item_id", F.array_join(kept, " ").alias("lookup"), intent.alias("intent"))


@query(
    """SELECT doc_id, regexp_extract(m, '^(\\w+)', 1) AS book, regexp_extract(m, ' ([0-9]+):', 1)::BIGINT AS chapter, regexp_extract(m, ':([0-9]+)', 1)::BIGINT AS verse, count(*) AS mentions
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}')) AS m FROM documents) GROUP BY ALL"""
)
def reference_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """References such as Name 3:16 in texts."""
    m = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ [0-9]{1,3}:[0-9]{1,3}"), F.lit(0))).alias("m"))
    number = lambda p: F.regexp_extract("m", p, 1).cast("long")
    return m.groupBy("doc_id", F.regexp_extract("m", r"^(\w+)", 1).alias("book"), number(" ([0-9]+):").alias("chapter"), number(":([0-9]+)").alias("verse")).agg(F.count("*").alias("mentions"))


@query(
    f"""WITH {SQL["verses"]} SELECT e.book, e.chapter, e.verse, e.doc_id AS first_id, coalesce(z.doc_id, -1) AS second_id, CASE WHEN e.book % 10 = 9 THEN 'test' WHEN e.book % 10 = 8 THEN 'validation' ELSE 'train' END AS split
FROM verses e LEFT JOIN verses z ON z.version = 'de' AND z.book = e.book AND z.chapter = e.chapter AND z.verse = e.verse WHERE e.version = 'en'"""
)
def verse_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One version's verses with another's where it has them (-1), and the split by book."""
    v = verses(table(spark, sf, "documents")).drop("text")
    e = v.where("version = 'en'").withColumnRenamed("doc_id", "first_id").drop("version")
    z = v.where("version = 'de'").withColumnRenamed("doc_id", "second_id").drop("version")
    b = F.pmod("book", F.lit(10))
    split = F.when(b == 9, "test").when(b == 8, "validation").otherwise("train")
    return e.join(z, ["book", "chapter", "verse"], "left").select("book", "chapter", "verse", "first_id", F.coalesce("second_id", F.lit(-1)).alias("second_id"), split.alias("split"))


@query(
    f"""WITH {_CASCADE_SQL}, d AS (SELECT query, id, level, row_number() OVER (PARTITION BY query ORDER BY level, length(headword), tier, id) AS place FROM m WHERE level IS NOT NULL),
c AS (SELECT query, min(doc_id) AS id FROM documents, asked WHERE contains(text, query) GROUP BY query)
SELECT query, CASE WHEN d.id IS NOT NULL THEN 'dictionary' ELSE 'corpus' END AS store, coalesce(d.id, c.id) AS id,
  CASE WHEN d.level = 0 THEN 'high' WHEN d.level IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM asked LEFT JOIN (SELECT * FROM d WHERE place = 1) d USING (query) LEFT JOIN c USING (query) WHERE coalesce(d.id, c.id) IS NOT NULL"""
)
def primary_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer a query: the best dictionary entry, else the first document that has it, with how sure it is."""
    best = top(_cascade(spark, sf), "query", ["level", F.char_length("headword"), "tier", "id"], 1).select("query", "id", "level")
    asked = F.array(*[F.lit(x) for x in ASKED])
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(asked, lambda q: F.contains(F.col("text"), q))).alias("query"))
    corpus = found.groupBy("query").agg(F.min("doc_id").alias("doc"))
    sure = F.when(F.col("level") == 0, "high").when(F.col("level").isNotNull(), "medium").otherwise("low")
    return best.join(corpus, "query", "full").select(
        "query", F.when(F.col("id").isNotNull(), "dictionary").otherwise("corpus").alias("store"), F.coalesce("id", "doc").alias("id"), sure.alias("confidence")
    )


_MESSAGES_SQL = """books AS (SELECT p_name AS book, min(p_partkey) AS rank FROM part GROUP BY p_name), keys AS (SELECT regexp_replace(lower(book), '[^0-9a-z]', '', 'g') AS key, book FROM books),
chapters AS (SELECT DISTINCT p_name AS book, p_size AS chapter FROM part),
messages AS (SELECT p_partkey AS message, CASE p_partkey % 5 WHEN 0 THEN 'please show me the ' WHEN 1 THEN 'Bible ' WHEN 2 THEN 'read ' WHEN 3 THEN '1 2 ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name[1]) || p_name[2:] ELSE p_name END || ' ' || p_size
  || CASE p_partkey % 3 WHEN 0 THEN ':' || p_size WHEN 1 THEN '' ELSE ' : 7 - 9' END || CASE WHEN p_partkey % 7 = 0 THEN ' and cold widget 3:1' ELSE '' END AS text FROM part)"""


@query(
    f"""WITH {_MESSAGES_SQL},
m AS (SELECT message, text, unnest(ms) AS m, generate_subscripts(ms, 1) AS nth FROM (SELECT *, regexp_extract_all(text, '(?:[1-3]\\s*)?\\p{{L}}[\\p{{L}}\\p{{N}}_'' .]{{0,80}}?\\s*\\d{{1,3}}(?:\\s*[:.]\\s*\\d{{1,3}}(?:\\s*[-–]\\s*\\d{{1,3}})?)?') AS ms FROM messages)),
p AS (SELECT message, nth, regexp_matches(lower(text), '\\bbible\\b') AS asks, regexp_extract(m, '^(.*?)\\s*(\\d{{1,3}})(?:\\s*[:.]\\s*(\\d{{1,3}})(?:\\s*[-–]\\s*(\\d{{1,3}}))?)?$', ['words', 'chapter', 'verse', 'last']) AS r FROM m),
w AS (SELECT message, nth, asks, string_split(trim(r.words), ' ') AS words, r.chapter::INT AS chapter, nullif(r.verse, '')::INT AS verse, nullif(r.last, '')::INT AS last FROM p),
s AS (SELECT *, unnest(range(1, len(words) + 1)) AS start FROM w), n AS (SELECT *, array_to_string(words[start:], ' ') AS name FROM s),
hit AS (SELECT message, nth, start, book, chapter, verse, coalesce(last, verse) AS last FROM n JOIN keys ON key = regexp_replace(lower(name), '[^0-9a-z]', '', 'g') WHERE verse IS NOT NULL OR asks OR NOT regexp_matches(name[1], '\\p{{Ll}}')
  QUALIFY row_number() OVER (PARTITION BY message ORDER BY nth, start) = 1)
SELECT message, book, chapter, verse, last FROM hit SEMI JOIN chapters USING (book, chapter)"""
)
def message_references(spark: SparkSession, sf: str) -> DataFrame:
    """The passage that a message names, book names of several words among them; part names are the books, sizes their chapters."""
    from ..operators.references import book_names, find_references

    parts, k = table(spark, sf, "part"), F.col("p_partkey")
    books = parts.groupBy(F.col("p_name").alias("book")).agg(F.min("p_partkey").alias("rank"))
    names = book_names(books.select("book", "rank", F.col("book").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("name_local")))
    opening = F.when(k % 5 == 0, "please show me the ").when(k % 5 == 1, "Bible ").when(k % 5 == 2, "read ").when(k % 5 == 3, "1 2 ").otherwise("")
    name = F.when(k % 2 == 0, F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)))).otherwise(F.col("p_name"))
    verse = F.when(k % 3 == 0, F.concat(F.lit(":"), "p_size")).when(k % 3 == 1, "").otherwise(" : 7 - 9")
    text = F.concat(opening, name, F.lit(" "), "p_size", verse, F.when(k % 7 == 0, " and cold widget 3:1").otherwise(""))
    return find_references(parts.select(k.alias("message"), text.alias("text")), names, parts.select(F.col("p_name").alias("book"), F.col("p_size").alias("chapter")))
