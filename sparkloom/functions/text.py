"""Text normalisation and keys as Column expressions (and their SQL forms for the oracles).

Word characters are letters, digits and the underscore of any script.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x0B\p{Z}]+"
NON_WORD = r"[^\p{L}\p{N}_\s\x0B\p{Z}'-]+"
WORD = r"[\p{L}\p{N}]+"
# What white space, and what other than word characters, is made a single space; a space alone is left, so a match is rare.
_SPACES = r"[\s\x0B\p{Z}&&[^ ]][\s\x0B\p{Z}]*+| [\s\x0B\p{Z}]++"
_GAPS = r"[^\p{L}\p{N}_' -][^\p{L}\p{N}_'-]*+| [^\p{L}\p{N}_'-]++"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; for sources that aren't known to be in it. ASCII and normal texts pass as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold_key(text: pd.Series) -> pd.Series:
    """Compatibility form, case folded, single spaces: the key of reference headwords."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split()))


def normalize_text(c: Column) -> Column:
    """Without byte order marks, white space single and trimmed; null is empty. For text in normal form C."""
    return F.trim(F.regexp_replace(_bare(c), _SPACES, " "))


def _bare(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit(""))


def normalize_word(c: Column) -> Column:
    """Lower case, other than word characters, apostrophe and hyphen to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(_bare(c)), _GAPS, " "))


def pair_key(source: Column, target: Column) -> Column:
    return F.sha1(F.concat(normalize_word(source), F.lit("\t"), normalize_word(target)))


def family_key(source: Column) -> Column:
    return F.sha1(normalize_word(source))


def bucket(digest: Column) -> Column:
    """First eight hex digits modulo a hundred."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def hash_split(digest: Column) -> Column:
    b = bucket(digest)
    return F.when(b < 90, "train").when(b < 95, "validation").otherwise("test")


def words(c: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def masked_text(c: Column) -> Column:
    """Lower-case words with numbers masked, one space between."""
    bare = F.replace(F.coalesce(c, F.lit("")), F.lit("\ufeff"), F.lit(""))
    spaced = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    return F.lower(F.regexp_replace(spaced, r"(?<![^ ])\p{Nd}+(?![^ ])", "<num>"))


def template_key(c: Column, names: Column | None = None) -> Column:
    """SHA-1 of the words with names (an array of lower-case words) and numbers masked."""
    masked = masked_text(c)
    if names is not None:
        masked = F.array_join(F.transform(F.split(masked, " "), lambda w: F.when(F.array_contains(names, w), "<name>").otherwise(w)), " ")
    return F.sha1(masked)


# Lower-case letters with marks and the same without.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def fold_marks(c: Column) -> Column:
    """Letters without their accents, for search."""
    return F.translate(c, MARKED, PLAIN)


def numbers(c: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(c, F.lit(r"\p{Nd}+"), F.lit(0)))


def length_log_ratio(source: Column, target: Column, least: int = 20) -> Column:
    """log of target over source characters; null when either is under ``least``."""
    return F.when(
        F.least(F.char_length(source), F.char_length(target)) >= least, F.log(F.char_length(target) / F.char_length(source))
    )


def fraction_of(key: Column) -> Column:
    """A key's place in [0, 1): first four bytes of its SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def spelling_text(c: Column) -> Column:
    """In lower case, with one form of apostrophes and hyphens."""
    # Patterns, for translate looks every character up; texts without such a mark pass as they are.
    folded = F.when(c.rlike("[’‘ʼ`´‐‑]"), F.regexp_replace(F.regexp_replace(c, "[’‘ʼ`´]", "'"), "[‐‑]", "-")).otherwise(c)
    return F.lower(folded)


def spelling_tokens(c: Column) -> Column:
    """Lower-case words of a to z with inner apostrophes and hyphens and an optional last apostrophe; one form of each mark."""
    return F.regexp_extract_all(spelling_text(c), F.lit("[a-z]++(?:['-][a-z]++)*+'?+"), F.lit(0))


def spelling_family(form: Column) -> Column:
    """Without apostrophes and hyphens, doubled vowels single."""
    return F.regexp_replace(F.regexp_replace(form, "['-]", ""), r"([aeiou])\1+", "$1")


def variant_key(c: Column) -> Column:
    """A text with case, spacing, punctuation and numbers set aside, to tell different translations."""
    found = F.regexp_extract_all(c, F.lit(WORD + "(?:['’]" + WORD + ")*"), F.lit(0))
    return F.regexp_replace(F.lower(F.array_join(found, " ")), r"\p{Nd}+", "#")


def split_alternatives(c: Column) -> Column:
    """``;`` separated alternatives, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def base_forms(word: Column) -> Column:
    """Candidate bases of a regular English inflection, likeliest first, distinct, of three letters at least."""

    def cut(n: int, add: str = "") -> Column:
        return F.concat(F.substr(word, F.lit(1), F.char_length(word) - n), F.lit(add))

    found = F.array_compact(
        F.array(
            F.when(word.endswith("ies"), cut(3, "y")),
            F.when(word.rlike("(?:s|x|z|ch|sh)es$"), cut(2)),
            F.when(word.endswith("s") & ~word.rlike("(?:ss|us|is)$"), cut(1)),
            F.when(word.endswith("ied"), cut(3, "y")),
            F.when(word.endswith("ed"), cut(2)),
            F.when(word.endswith("ed"), cut(2, "e")),
            F.when(word.rlike(r"(.)\1ed$") & (F.char_length(word) > 4), cut(3)),
            F.when(word.endswith("ing"), cut(3)),
            F.when(word.endswith("ing"), cut(3, "e")),
            F.when(word.rlike(r"(.)\1ing$") & (F.char_length(word) > 5), cut(4)),
        )
    )
    kept = F.array_distinct(F.filter(found, lambda x: (F.char_length(x) >= 3) & (x != word)))
    return F.when(F.char_length(word) >= 4, kept).otherwise(F.array().cast("array<string>"))


# The SQL forms.
def sql_text(x: str) -> str:
    return f"trim(regexp_replace(replace(coalesce({x}, ''), chr(65279), ''), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'))"


def sql_word(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({sql_text(x)}), '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\p{{Z}}''-]+', ' ', 'g'), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'))"


def sql_pair_key(s: str, t: str) -> str:
    return f"sha1({sql_word(s)} || chr(9) || {sql_word(t)})"


def sql_family_key(s: str) -> str:
    return f"sha1({sql_word(s)})"


def sql_bucket(d: str) -> str:
    return f"(('0x' || substr({d}, 1, 8))::BIGINT % 100)"


def sql_split(d: str) -> str:
    return f"CASE WHEN {sql_bucket(d)} < 90 THEN 'train' WHEN {sql_bucket(d)} < 95 THEN 'validation' ELSE 'test' END"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"


def sql_masked(x: str) -> str:
    return f"list_transform({sql_words(sql_text(x))}, lambda w: CASE WHEN regexp_full_match(w, '\\p{{Nd}}+') THEN '<num>' ELSE lower(w) END)"


def sql_template(x: str) -> str:
    return f"sha1(array_to_string({sql_masked(x)}, ' '))"


def sql_variant(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*'), lambda w: regexp_replace(lower(w), '\\p{{Nd}}+', '#', 'g')), ' ')"
