"""Standard spelling from a rule table: rewritten lines, flags, search forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.lineage import checkpointed
from ..operators.names import TITLES, swapped_names
from ..operators.rewriting import search_forms, standardized
from ..sources.views import SQL, line_pairs, lines, table
from .lexicon import _FORMS_SQL, base_counts, word_counts
from .registry import query

VERSION = "1.0"


def learned_rules(counts: DataFrame) -> DataFrame:
    """rule_id, variant, standard, mode: of words that differ by apostrophes, hyphens or doubled vowels the commonest is standard.

    Where the commonest has four fifths of a family's uses its variants are
    replaced, else flagged. A rule is named by its family's key. ``counts`` are
    those of ``base_counts``.
    """
    words = checkpointed(counts.withColumn("rule_id", t.spelling_family(F.col("form"))).where(F.col("form").rlike("^[a-z'-]+$")))
    best = words.groupBy("rule_id").agg(F.max(F.struct("n", "form")).alias("best"), F.sum("n").alias("uses"), F.count("*").alias("forms")).where("forms > 1 AND uses >= 5")
    mode = F.when(F.col("best.n") >= 0.8 * F.col("uses"), "replace").otherwise("flag")
    met = words.join(best, "rule_id").where(F.col("form") != F.col("best.form"))
    return met.select("rule_id", F.col("form").alias("variant"), F.col("best.form").alias("standard"), mode.alias("mode"))


_FAMILY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(form, '''', ''), '-', ''), 'aa+', 'a', 'g'), 'ee+', 'e', 'g'), 'ii+', 'i', 'g'), 'oo+', 'o', 'g'), 'uu+', 'u', 'g')"
_RULES_SQL = f"""{_FORMS_SQL}, fam AS (SELECT {_FAMILY} AS rule_id, form, n FROM base WHERE regexp_full_match(form, '[a-z''-]+')),
best AS (SELECT rule_id, arg_max(form, (n, form)) AS standard, max(n) AS most, sum(n) AS uses FROM fam GROUP BY rule_id HAVING count(*) > 1 AND sum(n) >= 5),
rules AS (SELECT rule_id, form AS variant, standard, most >= 0.8::DOUBLE * uses AS replaces FROM fam JOIN best USING (rule_id) WHERE form <> standard)"""
_RUN = "[\\p{L}''’‘ʼ`´-]+"


@query(
    f"""WITH {SQL["lines"]}, {_RULES_SQL},
tok AS (SELECT doc_id, line_no, line, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM (
  SELECT *, regexp_extract_all(line, '{_RUN}|[^\\p{{L}}''’‘ʼ`´-]+') AS parts FROM lines)),
hit AS (SELECT tok.*, rule_id, standard, replaces FROM tok LEFT JOIN rules ON variant = lower(translate(part, '’‘ʼ`´', ''''''''''''))),
cased AS (SELECT *, CASE WHEN NOT coalesce(replaces, false) THEN part
  WHEN length(regexp_replace(part, '[^\\p{{L}}]', '', 'g')) > 1 AND upper(part) = part THEN upper(standard)
  WHEN upper(part[1]) = part[1] AND lower(part[1]) <> part[1] THEN upper(standard[1]) || standard[2:] ELSE standard END AS made FROM hit),
whole AS (SELECT doc_id, line_no, line, string_agg(made, '' ORDER BY k) AS line_standard,
  coalesce(list(rule_id ORDER BY k) FILTER (replaces), []) AS used, count(*) FILTER (NOT replaces) AS flags FROM cased GROUP BY doc_id, line_no, line)
SELECT doc_id, line_no::BIGINT AS line_no, line_standard, array_to_string(list_sort(list_distinct(used)), ',') AS rules, flags, '{VERSION}' AS standard_version FROM whole WHERE len(used) > 0 OR flags > 0"""
)
def standard_form_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every line that the rules learned from the corpus change or flag, in its standard form, with the rules and the number of flags."""
    docs = table(spark, sf, "documents")
    rules = checkpointed(learned_rules(base_counts(word_counts(docs))))
    made = standardized(lines(docs).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"), "line", rules, VERSION)
    used, flags = F.col("line_standard_rules"), F.size("line_standard_flags").cast("long")
    return made.where((F.size(used) > 0) | (flags > 0)).select(
        "doc_id", "line_no", "line_standard", F.array_join(F.sort_array(used), ",").alias("rules"), flags.alias("flags"), "standard_version"
    )


@query(
    f"""WITH {_RULES_SQL}, forms2 AS (SELECT rule_id, list_prepend(min(standard), list(variant ORDER BY variant)) AS forms FROM rules GROUP BY rule_id),
k AS (SELECT unnest(forms) AS key, rule_id, forms FROM forms2), one AS (SELECT key, arg_min(forms, rule_id) AS forms FROM k GROUP BY key)
SELECT word, array_to_string(coalesce(forms, [word]), ',') AS forms FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part
  UNION SELECT form FROM base WHERE n >= 5) LEFT JOIN one ON key = lower(trim(word))"""
)
def standard_search_forms(spark: SparkSession, sf: str) -> DataFrame:
    """All spellings that a search for a word should match, for the dictionary's words and the corpus's common ones."""
    docs = table(spark, sf, "documents")
    counts = checkpointed(base_counts(word_counts(docs)))
    rules = checkpointed(learned_rules(counts))
    asked = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).union(counts.where("n >= 5").select("form"))
    return search_forms(asked.distinct(), rules).select("word", F.array_join("forms", ",").alias("forms"))


_TITLED = "regexp_matches({{side}}, '(?:^|[^\\p{{{{L}}}}\\p{{{{N}}}}_])(?i:{titles})\\.?\\s+(?:The|Of|Und|La|De)(?:[^\\p{{{{L}}}}\\p{{{{N}}}}_-]|$)')".format(titles="|".join(TITLES))


@query(
    f"""WITH {SQL["line_pairs"]}, people AS (SELECT p_name FROM (VALUES ('The'), ('Of'), ('Und'), ('La'), ('De')) AS v(p_name)),
w AS (SELECT id, {_TITLED.format(side="source_text")} OR {_TITLED.format(side="target_text")} AS titled, list_sort(list_filter(regexp_extract_all(source_text, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: x IN ('The', 'Of', 'Und', 'La', 'De'))) AS s, list_sort(list_filter(regexp_extract_all(target_text, '[\\p{{L}}\\p{{N}}_-]+'), lambda x: x IN ('The', 'Of', 'Und', 'La', 'De'))) AS g FROM line_pairs)
SELECT outcome, count(*) AS pairs FROM (SELECT CASE WHEN len(s) = 0 THEN 'no_name' WHEN titled THEN 'behind_a_title' WHEN s <> g THEN 'sides_differ' ELSE 'swapped' END AS outcome FROM w) GROUP BY outcome"""
)
def name_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of every line pair when its names are swapped; capitalised words that are common in lines stand in for names."""
    people = spark.createDataFrame([(n, "f" if n in ("La", "De") else "m") for n in ("The", "Of", "Und", "La", "De")], "name string, gender string")
    pool = table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "f").otherwise("m").alias("gender"), F.initcap(F.substring_index("p_name", " ", 1)).alias("name"))
    made = swapped_names(line_pairs(table(spark, sf, "documents")), people, pool)
    return made.groupBy("outcome").agg(F.count("*").alias("pairs"))
