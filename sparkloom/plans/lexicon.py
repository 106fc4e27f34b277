"""Spelling variants, n-grams, names, rules, audits and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.grams import frequent_grams
from ..operators.lineage import checkpointed
from ..operators.prefix_join import similar_groups
from ..operators.shingles import loose_shingles
from ..sources.views import SQL, lines, table
from .registry import query


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_TOK = "regexp_extract_all(translate(lower(coalesce(text, '')), '’‘ʼ`´‐‑', '''''''''''--'), '[a-z]+(?:[''-][a-z]+)*''?')"
_FORMS_SQL = f"""forms AS (SELECT lang AS src, unnest({_TOK}) AS form FROM documents),
words AS (SELECT src, form, count(*) AS n FROM forms GROUP BY ALL), base AS (SELECT rtrim(form, '''') AS form, sum(n)::BIGINT AS n FROM words GROUP BY 1)"""


def word_counts(docs: DataFrame) -> DataFrame:
    """src, form, n: spelling tokens of each language; counted before the shuffle."""
    return docs.select(F.col("lang").alias("src"), F.explode(t.spelling_tokens(F.coalesce("text", F.lit("")))).alias("form")).groupBy("src", "form").agg(F.count("*").alias("n"))


def base_counts(words: DataFrame) -> DataFrame:
    """Counts over all sources with a last apostrophe folded in."""
    return words.groupBy(F.regexp_replace("form", "'+$", "").alias("form")).agg(F.sum("n").alias("n"))


def ngrams(docs: DataFrame, n: int) -> DataFrame:
    """src, w1 to wn, uses: at every place the n tokens that begin there, counted per source; null where the text ends before."""
    w = docs.select(F.col("lang").alias("src"), t.spelling_tokens(F.coalesce("text", F.lit(""))).alias("w"))
    names = [f"w{k + 1}" for k in range(n)]
    # Neighbours come from the text's own array; what reaches past its end is null.
    shifted = [F.slice("w", F.lit(k + 1), F.greatest(F.size("w"), F.lit(1))).alias(name) for k, name in enumerate(names)]
    each = w.select("src", F.inline(F.arrays_zip(*shifted)).alias(*names))
    return each.groupBy("src", *names).agg(F.count("*").alias("uses"))


@query(
    f"""WITH w AS (SELECT lang AS src, {_TOK} AS w FROM documents), g AS (
  SELECT src, 1 AS n, unnest(w) AS gram FROM w UNION ALL
  SELECT src, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL
  SELECT src, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w)
SELECT src, n, gram, count(*) AS uses FROM g GROUP BY ALL HAVING uses >= 5"""
)
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words, pairs and triples used five times or more in a language."""
    # Most triples are used once: they are counted by hashes, and only what may be frequent travels as text.
    return frequent_grams(F.col("lang"), t.spelling_text(F.coalesce("text", F.lit(""))), _docs(spark, sf), 5)


@query(
    f"""WITH {_FORMS_SQL}, f AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(form, '''', ''), '-', ''), 'aa+', 'a', 'g'), 'ee+', 'e', 'g'), 'ii+', 'i', 'g'), 'oo+', 'o', 'g'), 'uu+', 'u', 'g') AS key, form, n FROM base)
SELECT key, array_to_string(list(form ORDER BY n DESC, form), ',') AS spellings, sum(n)::BIGINT AS total, (sum(n) - max(n))::BIGINT AS minority FROM f GROUP BY key HAVING count(*) > 1 AND sum(n) >= 5"""
)
def variant_families(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings that differ only by apostrophes, hyphens or doubled vowels."""
    b = base_counts(word_counts(_docs(spark, sf))).withColumn("key", t.spelling_family(F.col("form")))
    g = b.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "form"))).alias("f"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("minority"))
    return g.where((F.size("f") > 1) & (F.col("total") >= 5)).select("key", F.array_join("f.form", ",").alias("spellings"), "total", "minority")


@query(
    f"""WITH {_FORMS_SQL}, allw AS (SELECT form, sum(n)::BIGINT AS n FROM words GROUP BY form), w AS (SELECT {_TOK} AS w FROM documents),
p AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w) GROUP BY g),
c AS (SELECT replace(p.g, ' ', '') AS joined, p.g AS split, replace(p.g, ' ', '-') AS hyphenated, p.n AS n_split FROM p UNION ALL
      SELECT replace(a.form, '-', ''), replace(a.form, '-', ' '), a.form, 0 FROM allw a WHERE len(string_split(a.form, '-')) = 2 AND NOT contains(a.form, '''')),
m AS (SELECT joined, split, hyphenated, max(n_split) AS n_split FROM c WHERE NOT contains(split, '''') AND len(string_split(split, ' ')) = 2 AND NOT contains(split, '-') GROUP BY ALL),
k AS (SELECT m.*, j.n AS n_joined, coalesce(h.n, 0) AS n_hyphen FROM m JOIN allw j ON j.form = m.joined LEFT JOIN allw h ON h.form = m.hyphenated WHERE length(joined) >= 3)
SELECT joined, split, n_joined + n_split + n_hyphen AS total, n_joined + n_split + n_hyphen - greatest(n_joined, n_split, n_hyphen) AS minority
FROM k WHERE n_joined + n_split + n_hyphen >= 5 QUALIFY row_number() OVER (PARTITION BY joined ORDER BY n_split + n_hyphen DESC, length(split_part(split, ' ', 1))) = 1"""
)
def join_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words seen joined and also as two words or with a hyphen; the best cut of each.

    Pairs and hyphenated forms propose cuts, so no word is cut at every place.
    """
    counts = checkpointed(ngrams(_docs(spark, sf).withColumn("lang", F.lit(None).cast("string")), 2).drop("src"))
    allw = checkpointed(counts.groupBy(F.col("w1").alias("form")).agg(F.sum("uses").alias("n")))
    plain = F.col("split").rlike("^[a-z]+ [a-z]+$")
    c = counts.where("w2 IS NOT NULL").select(F.concat_ws(" ", "w1", "w2").alias("split"), F.col("uses").alias("n_split")).unionByName(
        allw.where(F.col("form").rlike("^[a-z]+-[a-z]+$")).select(F.translate("form", "-", " ").alias("split"), F.lit(0).cast("long").alias("n_split"))
    ).where(plain).groupBy("split").agg(F.max("n_split").alias("n_split"))
    k = c.withColumns({"joined": F.regexp_replace("split", " ", ""), "hyphenated": F.translate("split", " ", "-")}).where(F.char_length("joined") >= 3)
    k = k.join(allw.select(F.col("form").alias("joined"), F.col("n").alias("n_joined")), "joined").join(
        allw.select(F.col("form").alias("hyphenated"), F.col("n").alias("h")), "hyphenated", "left"
    ).withColumn("n_hyphen", F.coalesce("h", F.lit(0)))
    best = k.groupBy("joined").agg(
        F.min(F.struct(-(F.col("n_split") + F.col("n_hyphen")), F.char_length(F.substring_index("split", " ", 1)), "split", "n_split", "n_hyphen", "n_joined")).alias("b")
    ).select("joined", "b.split", "b.n_split", "b.n_hyphen", "b.n_joined")
    total = F.col("n_joined") + F.col("n_split") + F.col("n_hyphen")
    return best.select("joined", "split", total.alias("total"), (total - F.greatest("n_joined", "n_split", "n_hyphen")).alias("minority")).where("total >= 5")


_VOTE_SQL = f"""{_FORMS_SQL}, fam AS (SELECT src, rtrim(form, '''') AS form, sum(n)::BIGINT AS n FROM words GROUP BY ALL),
k AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(form, '''', ''), '-', ''), 'aa+', 'a', 'g'), 'ee+', 'e', 'g'), 'ii+', 'i', 'g'), 'oo+', 'o', 'g'), 'uu+', 'u', 'g') AS key, * FROM fam),
multi AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT form) > 1),
r AS (SELECT key, src, form, n, sum(n) OVER (PARTITION BY key, src) AS uses, row_number() OVER (PARTITION BY key, src ORDER BY n DESC, form) AS place FROM k JOIN multi USING (key)),
s AS (SELECT key, src, max(form) FILTER (place = 1) AS best, max(uses) AS uses, coalesce(max(n) FILTER (place = 2), 0) AS second FROM r GROUP BY key, src HAVING max(uses) >= 3),
v AS (SELECT key, best, count(*) AS votes, max((src = 'en')::INT) AS ref FROM s GROUP BY key, best),
d AS (SELECT key, bool_or(uses >= 20 AND second / uses >= 0.2::DOUBLE) AS divided FROM s GROUP BY key)
SELECT key, CASE WHEN divided THEN '' ELSE arg_min(best, (-votes, -ref, best)) END AS suggestion,
   CASE WHEN divided THEN 'check meaning' WHEN count(*) = 1 THEN 'strong' ELSE 'mixed' END AS strength FROM v JOIN d USING (key) GROUP BY key, divided"""


@query(f"WITH {_VOTE_SQL}")
def spelling_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Each language votes for its commonest spelling of a family; a divided one stops the suggestion; English breaks ties."""
    w = word_counts(_docs(spark, sf)).groupBy("src", F.regexp_replace("form", "'+$", "").alias("form")).agg(F.sum("n").alias("n"))
    # Written out: the families and their votes both need it, and the texts are read once.
    k = checkpointed(w.withColumn("key", t.spelling_family(F.col("form"))))
    multi = k.groupBy("key").agg(F.min("form").alias("x"), F.max("form").alias("y")).where("x <> y").select("key")
    per = k.join(multi, "key").groupBy("key", "src").agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "form"))).alias("f"), F.sum("n").alias("uses")).where("uses >= 3")
    s = per.select("key", "src", "uses", F.col("f")[0]["form"].alias("best"), F.coalesce(-F.get("f", F.lit(1))[f"col1"], F.lit(0)).alias("second"))
    divided = (F.col("uses") >= 20) & (F.col("second") / F.col("uses") >= 0.2)
    v = s.groupBy("key", "best").agg(F.count("*").alias("votes"), F.max((F.col("src") == "en").cast("int")).alias("ref"), F.bool_or(divided).alias("d"))
    g = v.groupBy("key").agg(F.min(F.struct(-F.col("votes"), -F.col("ref"), "best"))["best"].alias("best"), F.count("*").alias("n"), F.bool_or("d").alias("d"))
    return g.select("key", F.when(F.col("d"), "").otherwise(F.col("best")).alias("suggestion"), F.when(F.col("d"), "check meaning").when(F.col("n") == 1, "strong").otherwise("mixed").alias("strength"))


#: Stand-in spelling rules: variants and their standard.
RULES = {"the": ("ther", "then"), "and": ("ande",), "mit": ("miten",)}


def _rule_map() -> Column:
    return F.create_map(*[F.lit(x) for standard, variants in RULES.items() for v in variants for x in (v, standard)])


_RULE_SQL = "rules(variant, standard) AS (VALUES ('ther', 'the'), ('then', 'the'), ('ande', 'and'), ('miten', 'mit'))"


@query(
    f"""WITH {SQL["lines"]}, {_RULE_SQL}, o AS (SELECT doc_id, line_no, lower(unnest(regexp_extract_all(line, '\\p{{L}}+'))) AS variant FROM lines)
SELECT variant, standard, count(*) AS occurrences, count(DISTINCT (doc_id, line_no)) AS lines_changed FROM o JOIN rules USING (variant) GROUP BY ALL"""
)
def standard_form_preview(spark: SparkSession, sf: str) -> DataFrame:
    """What the spelling rules would change: occurrences and lines of each variant."""
    w = lines(_docs(spark, sf)).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\p{L}+"), F.lit(0))).alias("w")).select("doc_id", "line_no", F.lower("w").alias("variant"))
    hit = w.withColumn("standard", F.try_element_at(_rule_map(), F.col("variant"))).where(F.col("standard").isNotNull())
    per = hit.groupBy("variant", "standard", "doc_id", "line_no").agg(F.count("*").alias("n"))
    return per.groupBy("variant", "standard").agg(F.sum("n").alias("occurrences"), F.count("*").alias("lines_changed"))


def standardize(c: Column) -> Column:
    """Variants to their standard form at word boundaries, the longest variant first, a capital first letter kept."""
    for variant, standard in sorted(((v, s) for s, vs in RULES.items() for v in vs), key=lambda x: -len(x[0])):
        bounds = r"(?<![\p{L}\p{N}'-])", r"(?![\p{L}\p{N}'-])"
        c = F.regexp_replace(c, f"{bounds[0]}{variant}{bounds[1]}", standard)
        c = F.regexp_replace(c, f"{bounds[0]}{variant.capitalize()}{bounds[1]}", standard.capitalize())
    return c


@query()
def standard_form_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Lines the rules change, before and after; SQL's engine has no look-around, a test checks it."""
    l = lines(_docs(spark, sf)).select("doc_id", F.col("line_no").cast("long"), "line", standardize(F.col("line")).alias("standard"))
    return l.where(F.col("line") != F.col("standard"))


@query(
    f"""WITH {_FORMS_SQL}, dict AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS form FROM part)
SELECT form, n FROM base WHERE n >= 10 AND form NOT IN (SELECT form FROM dict)"""
)
def missing_words(spark: SparkSession, sf: str) -> DataFrame:
    """Common corpus words that the dictionary lacks."""
    known = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("form")).distinct()
    return base_counts(word_counts(_docs(spark, sf))).where("n >= 10").join(known, "form", "left_anti")


@query(
    f"""WITH {_FORMS_SQL}, c AS (SELECT form, unnest(list_filter([
  CASE WHEN form LIKE '%ies' THEN left(form, length(form) - 3) || 'y' END, CASE WHEN regexp_matches(form, '(s|x|z|ch|sh)es$') THEN left(form, length(form) - 2) END,
  CASE WHEN form LIKE '%s' AND NOT regexp_matches(form, '(ss|us|is)$') THEN left(form, length(form) - 1) END, CASE WHEN form LIKE '%ied' THEN left(form, length(form) - 3) || 'y' END,
  CASE WHEN form LIKE '%ed' THEN left(form, length(form) - 2) END, CASE WHEN form LIKE '%ed' THEN left(form, length(form) - 2) || 'e' END,
  CASE WHEN form LIKE '%ed' AND length(form) > 4 AND form[-3] = form[-4] THEN left(form, length(form) - 3) END, CASE WHEN form LIKE '%ing' THEN left(form, length(form) - 3) END,
  CASE WHEN form LIKE '%ing' THEN left(form, length(form) - 3) || 'e' END, CASE WHEN form LIKE '%ing' AND length(form) > 5 AND form[-4] = form[-5] THEN left(form, length(form) - 4) END], lambda x: x IS NOT NULL)) AS base_form,
  generate_subscripts([1,2,3,4,5,6,7,8,9,10], 1) AS x FROM base WHERE n >= 3 AND length(form) >= 4)
SELECT DISTINCT c.form, c.base_form FROM c JOIN base b ON b.form = c.base_form WHERE length(c.base_form) >= 3 AND c.base_form <> c.form"""
)
def inflected_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Words with a candidate base that is a word too."""
    b = base_counts(word_counts(_docs(spark, sf)))
    c = b.where("n >= 3").select("form", F.explode(t.base_forms(F.col("form"))).alias("base_form"))
    return c.join(b.select(F.col("form").alias("base_form")), "base_form").select("form", "base_form").distinct()


@query("SELECT p_name AS headword, p_type AS pos, count(*) AS entries, min(p_partkey) AS first_id FROM part GROUP BY p_name, p_type HAVING count(*) > 1")
def duplicate_headwords(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy(F.col("p_name").alias("headword"), F.col("p_type").alias("pos"))
    return g.agg(F.count("*").alias("entries"), F.min("p_partkey").alias("first_id")).where("entries > 1")


@query(
    """WITH e AS (SELECT p_name, count(DISTINCT p_brand) AS sources FROM part GROUP BY p_name)
SELECT sources, count(*) AS headwords FROM e GROUP BY sources"""
)
def entries_by_sources(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("sources"))
    return e.groupBy("sources").agg(F.count("*").alias("headwords"))


@query(
    """SELECT p_partkey AS id, array_to_string(list_sort(list(other)), ',') AS others FROM (
  SELECT a.p_partkey, b.p_type AS other, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_type) AS k FROM part a JOIN (SELECT DISTINCT p_name, p_type FROM part) b ON a.p_name = b.p_name AND a.p_type <> b.p_type)
WHERE k <= 4 GROUP BY p_partkey"""
)
def other_senses(spark: SparkSession, sf: str) -> DataFrame:
    """Up to four other senses under the same headword; senses are gathered once a headword, then joined."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    senses = p.groupBy("p_name").agg(F.array_sort(F.collect_set("p_type")).alias("all"))
    others = F.slice(F.array_remove("all", F.col("p_type")), 1, 4)
    return p.join(senses, "p_name").select(F.col("p_partkey").alias("id"), others.alias("o")).where(F.size("o") > 0).select("id", F.array_join("o", ",").alias("others"))


@query(
    f"""WITH {SQL["lines"]}, w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}]+')[2:]) AS form FROM lines)
SELECT name, sum(n)::BIGINT AS lines_with, arg_min(form, (-n, form)) AS form FROM (SELECT name, form, count(*) AS n FROM (
  SELECT lower(form) AS name, doc_id, line_no, min(form) AS form FROM w WHERE regexp_matches(form, '^\\p{{Lu}}') GROUP BY ALL) GROUP BY ALL) GROUP BY name HAVING lines_with >= 20"""
)
def name_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words inside lines by how many lines have them, with the commonest form (a line counts its least)."""
    w = lines(_docs(spark, sf)).select("doc_id", "line_no", F.explode(F.array_distinct(F.slice(t.words(F.col("line")), 2, 1 << 30))).alias("form")).where(F.col("form").rlike(r"^\p{Lu}"))
    per = w.groupBy(F.lower("form").alias("name"), "doc_id", "line_no").agg(F.min("form").alias("form"))
    forms = per.groupBy("name", "form").agg(F.count("*").alias("n"))
    commonest = F.min(F.struct(-F.col("n"), "form")).alias("best")
    return forms.groupBy("name").agg(F.sum("n").alias("lines_with"), commonest).where("lines_with >= 20").select("name", "lines_with", "best.form")


@query()
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that is near another text (four fifths of words and word pairs), with its group, named by its least doc_id.

    Equal texts are one while searching and share a group.
    """
    d = _docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    groups = similar_groups(d, loose_shingles, 0.8)
    placed = d.select("doc_id", "key").join(groups.withColumnRenamed("node", "key"), "key")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return placed.join(least, "root").select("doc_id", "group_id")
