"""Quality flags, scores and filter reasons of sentence pairs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import numbers

# Function words, penalties and flag classes.
FUNCTION_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "to", "of", "and", "in", "that", "it", "for", "on", "with", "as", "this",
    "by", "from", "or", "at",
)
PENALTIES = {
    "empty": 1.0,
    "identical": 0.7,
    "invalid_unicode": 0.6,
    "html_or_script": 0.6,
    "suspicious_repeat": 0.5,
    "possible_language_mismatch": 0.35,
    "extremely_long": 0.2,
    "extremely_short": 0.15,
    "target_reused": 0.4,
    "number_mismatch": 0.3,
    "length_ratio_outlier": 0.25,
}
OTHER_PENALTY = 0.1
HARD_FLAGS = ("html_or_script", "identical", "invalid_unicode", "number_mismatch", "possible_language_mismatch", "suspicious_repeat")
SOFT_FLAGS = ("extremely_long", "extremely_short", "length_ratio_outlier", "target_reused")

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
HTML = r"(?i)<(?:script|style|iframe|object|embed|link|meta)\b|</?[a-z][^>]{0,80}>"
REPEAT = r"(.)\1{8,}"
MISMATCH_SHARE = 0.45


_GAP = r"\s\x0B\p{Z}"
# A run without white space; most are of visible ASCII characters, which one range tells.
_PIECE = f"(?:[!-~]++|[^{_GAP}])++"
_TWO_PIECES = f"[^{_GAP}][{_GAP}]++[^{_GAP}]"
MOST_PIECES = 80
# What ASCII words are made of.
_IN_WORD = r"[\w'-]"
_KNOWN = f"(?i)(?<!{_IN_WORD})(?:{'|'.join(FUNCTION_WORDS)})(?!{_IN_WORD})"


def _many_pieces(c: Column) -> Column:
    """More than ``MOST_PIECES`` runs without white space; shorter texts than those with a space between can't have them and aren't counted."""
    return F.coalesce((F.char_length(c) > 2 * MOST_PIECES) & (F.regexp_count(c, F.lit(_PIECE)) > MOST_PIECES), F.lit(False))


def mismatch(target: Column) -> Column:
    """An ASCII target that is English by its share of function words."""
    known = F.regexp_count(target, F.lit(_KNOWN))
    # The cheap test first: most other texts end there, and what is left is ASCII.
    return ~target.rlike(r"[^\x00-\x7f]") & (known > 0) & (known / F.regexp_count(target, F.lit(f"{_IN_WORD}++")) >= MISMATCH_SHARE)


def quality_flags(source: Column, target: Column) -> Column:
    """The row-level flags in their fixed order; an empty side gives ``empty`` alone."""
    either = lambda pattern: source.rlike(pattern) | target.rlike(pattern)
    # A side's second run shows early in it; a null side leaves it to the other.
    two = F.coalesce(source.rlike(_TWO_PIECES), F.lit(False)) | F.coalesce(target.rlike(_TWO_PIECES), F.lit(False))
    short = F.coalesce(source, target).isNotNull() & ~two
    long = (F.greatest(F.char_length(source), F.char_length(target)) > 600) | _many_pieces(source) | _many_pieces(target)
    html = (source.contains("<") & source.rlike(HTML)) | (target.contains("<") & target.rlike(HTML))
    flags = F.array_compact(
        F.array(
            F.when(source == target, "identical"),
            F.when(either(CONTROL), "invalid_unicode"),
            F.when(html, "html_or_script"),
            F.when(either(REPEAT), "suspicious_repeat"),
            F.when(short, "extremely_short"),
            F.when(long, "extremely_long"),
            F.when(mismatch(target), "possible_language_mismatch"),
        )
    )
    return F.when((source == "") | (target == ""), F.array(F.lit("empty"))).otherwise(flags)


def quality_score(flags: Column) -> Column:
    """One less the flags' penalties, not below 0, to three places."""
    table = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    left = F.aggregate(flags, F.lit(1.0), lambda acc, f: acc - F.coalesce(F.try_element_at(table, f), F.lit(OTHER_PENALTY)))
    return F.bround(F.greatest(F.lit(0.0), left), 3)


def number_mismatch(source: Column, target: Column) -> Column:
    """The digit runs of both sides differ as multisets."""
    return numbers(source) != numbers(target)


def hard_reasons(source: Column, target: Column, flags: Column, excluded: Column) -> Column:
    """Why a pair is quarantined, in order; empty if it isn't."""
    s, t = F.trim(source), F.trim(target)
    own = F.array_compact(
        F.array(
            F.when(excluded, "excluded_or_rejected"),
            F.when(s == "", "empty_source"),
            F.when(t == "", "empty_target"),
            F.when((s != "") & (t != "") & (F.lower(s) == F.lower(t)), "source_copied_as_target"),
        )
    )
    return F.concat(own, F.array_sort(F.array_intersect(flags, F.array(*[F.lit(x) for x in HARD_FLAGS]))))


def soft_reasons(flags: Column) -> Column:
    return F.array_sort(F.array_intersect(flags, F.array(*[F.lit(x) for x in SOFT_FLAGS])))


def uncertainty(score: Column, flags: Column, old_model: Column) -> Column:
    """How much a row needs a reviewer: a low score, soft flags, an outdated generator."""
    return F.bround(1 - F.coalesce(score, F.lit(0.0)) + 0.5 * F.size(soft_reasons(flags)) + F.when(old_model, 1.0).otherwise(0.0), 4)


# The SQL forms.
_W = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)


def _sql_repeat(x: str) -> str:
    return f"list_bool_or(list_transform(range(1, greatest(length({x}) - 7, 1)), lambda i: substr({x}, i, 9) = repeat(substr({x}, i, 1), 9) AND substr({x}, i, 1) <> chr(10)))"


def sql_flags(s: str, t: str) -> str:
    """A DuckDB list of the flags."""
    n = lambda x: f"len(list_filter(regexp_split_to_array({x}, '[\\s\\x0B\\p{{Z}}]+'), lambda w: w <> ''))"
    toks = f"list_filter(regexp_split_to_array(lower(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\p{{Z}}''-]+', ' ', 'g')), '[\\s\\x0B\\p{{Z}}]+'), lambda w: w <> '')"
    either = lambda p: f"(regexp_matches({s}, '{p}') OR regexp_matches({t}, '{p}'))"
    return f"""CASE WHEN {s} = '' OR {t} = '' THEN ['empty'] ELSE list_filter([
      CASE WHEN {s} = {t} THEN 'identical' END,
      CASE WHEN {either(CONTROL)} THEN 'invalid_unicode' END,
      CASE WHEN {either(HTML)} THEN 'html_or_script' END,
      CASE WHEN coalesce({_sql_repeat(s)}, false) OR coalesce({_sql_repeat(t)}, false) THEN 'suspicious_repeat' END,
      CASE WHEN greatest({n(s)}, {n(t)}) <= 1 THEN 'extremely_short' END,
      CASE WHEN greatest(length({s}), length({t})) > 600 OR greatest({n(s)}, {n(t)}) > 80 THEN 'extremely_long' END,
      CASE WHEN len({toks}) > 0 AND len(list_filter({toks}, lambda w: w IN ({_W}))) / len({toks}) >= 0.45 AND NOT regexp_matches({t}, '[^\\x00-\\x7f]') THEN 'possible_language_mismatch' END
    ], lambda f: f IS NOT NULL) END"""


def sql_score(flags: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTIES.items())
    return f"round(greatest(0.0, 1.0 - coalesce(list_sum(list_transform({flags}, lambda f: (CASE f {cases} ELSE {OTHER_PENALTY} END)::DOUBLE)), 0)), 3)"
