"""Text and quality functions by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import quality as q
from sparkloom.functions import text as t


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


def test_normalisation(spark):
    assert one(spark, t.normalize_text(F.col("a")), a="﻿ a b\t\n c ") == "a b c"
    assert one(spark, t.normalize_text(F.col("a")), a=None) == ""
    assert one(spark, t.normalize_word(F.col("a")), a="Don't  STOP — me_now, co-op! ÉTÉ") == "don't stop me_now co-op été"
    assert one(spark, t.nfc(F.col("a")), a="é") == "é"
    assert one(spark, t.casefold_key(F.col("a")), a=" Straße ﬁ ") == "strasse fi"


def test_split_bucket_by_hand(spark):
    digest = hashlib.sha1(b"hello world").hexdigest()
    assert int(digest[:8], 16) % 100 == 37
    assert one(spark, t.bucket(t.family_key(F.col("a"))), a="Hello, World!") == 37
    assert one(spark, t.hash_split(t.family_key(F.col("a"))), a="Hello, World!") == "train"


def test_template_masks_names_and_numbers(spark):
    names = F.array(F.lit("tom"), F.lit("mary"))
    a, b = (one(spark, t.template_key(F.col("a"), names), a=x) for x in ("Tom is 30.", "Mary is 25!"))
    assert a == b == hashlib.sha1(b"<name> is <num>").hexdigest()


@pytest.mark.parametrize("s, g, differ", [("Room 12 at 3", "X 3 Y 12", False), ("Room 12", "X 21", True), ("a", "b", False), ("1 1", "1", True)])
def test_number_mismatch(spark, s, g, differ):
    assert one(spark, q.number_mismatch(F.col("s"), F.col("g")), s=s, g=g) is differ


@pytest.mark.parametrize(
    "s, g, flags, score",
    [
        ("", "x", ["empty"], 0.0),
        ("same text here", "same text here", ["identical"], 0.3),
        ("hi", "yo", ["extremely_short"], 0.85),
        ("see <b>this</b> now", "plain words here", ["html_or_script"], 0.4),
        ("wow aaaaaaaaa yes", "plain words here", ["suspicious_repeat"], 0.5),
        ("bonjour le monde", "this is the cat and it was on the mat", ["possible_language_mismatch"], 0.65),
        ("a\x01b c", "plain words here", ["invalid_unicode"], 0.4),
        ("word " * 81, "plain words here", ["extremely_long"], 0.8),
    ],
)
def test_flags_and_scores(spark, s, g, flags, score):
    f = q.quality_flags(F.col("s"), F.col("g"))
    assert one(spark, f, s=s, g=g) == flags and one(spark, q.quality_score(f), s=s, g=g) == score


def test_filter_reasons(spark):
    f = F.array(F.lit("number_mismatch"), F.lit("extremely_short"), F.lit("html_or_script"))
    hard = q.hard_reasons(F.col("s"), F.col("g"), f, F.lit(True))
    assert one(spark, hard, s="Same ", g="same") == ["excluded_or_rejected", "source_copied_as_target", "html_or_script", "number_mismatch"]
    assert one(spark, q.soft_reasons(f), s="x") == ["extremely_short"]


@pytest.mark.parametrize("form", ["baak", "bak", "ba-ak"])
def test_spelling_family(spark, form):
    assert one(spark, t.spelling_family(F.col("a")), a=form) == "bak"


def test_spelling_tokens_fold_marks(spark):
    assert one(spark, t.spelling_tokens(F.col("a")), a="Pa’s ba‐ak topa' x2") == ["pa's", "ba-ak", "topa'", "x"]


@pytest.mark.parametrize(
    "word, bases",
    [("cities", ["city", "citie"]), ("boxes", ["box", "boxe"]), ("stopped", ["stopp", "stoppe", "stop"]), ("making", ["mak", "make"]), ("running", ["runn", "runne", "run"]), ("bus", []), ("glass", []), ("tried", ["try", "tri", "trie"])],
)
def test_base_forms(spark, word, bases):
    assert one(spark, t.base_forms(F.col("a")), a=word) == bases


def test_alternatives(spark):
    assert one(spark, t.split_alternatives(F.col("a")), a=" a; b ;; c") == ["a", "b", "c"]


def test_a_word_form_takes_one_pattern(spark):
    """White space and marks go in one pass, and single spaces aren't matched; the result is that of the three steps."""
    text = "\ufeff The\u00a0 red-hot  'bolt'\t\x0b_x_, (no. 7)\u3000é!\x85\n "
    assert one(spark, t.normalize_word(F.col("a")), a=text) == "the red-hot 'bolt' _x_ no 7 é"
    assert str(t.normalize_word(F.col("a"))).count("regexp_replace") == 1


def test_flags_look_at_texts_no_longer_than_they_must(spark):
    """A flag's patterns stop early or run over long texts only; no text is rewritten to count its words."""
    rows = [
        ("a " * 80, "x"), ("a " * 80 + "b", "x"), ("é　" * 81, "x"), ("x", "y"), ("x", "y z"), (None, "y"), ("x", None), (None, None),
        ("un deux", "The cat, and (the) hat"), ("un deux", "the-cat and'the hat"), ("un deux", "of\x1fTHE;cat"), ("un deux", "the é"),
    ]
    flags = q.quality_flags(F.col("s"), F.col("t"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string").select("i", flags.alias("flags"))
    short, long, english = ["extremely_short"], ["extremely_long"], ["possible_language_mismatch"]
    want = [[], long, long, short, [], short, short, [], english, [], ["invalid_unicode", *english], []]
    assert [r["flags"] for r in df.orderBy("i").collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
