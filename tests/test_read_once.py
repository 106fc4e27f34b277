"""Queries whose texts are dear to cut into words read them once."""

from collections import Counter

import pytest

from sparkloom.plans import registry
from sparkloom.plans.lexicon import ngrams


@pytest.mark.parametrize("name", ["ngram_counts", "join_variants", "spelling_votes", "standard_search_forms", "pair_search_bm25"])
def test_words_are_counted_before_they_are_needed_twice(spark, sf_dir, name):
    made = registry.queries()[name](spark, sf_dir)
    assert "documents.parquet" not in made._jdf.queryExecution().toString()


def test_tokens_and_their_neighbours(spark):
    texts = ["", None, "One", "one two", "It’s a well‐known İ it`s a", "x ' - y-", "a b a b a"]
    docs = spark.createDataFrame([("l", x) for x in texts], "lang string, text string")
    said = [[], [], ["one"], ["one", "two"], ["it's", "a", "well-known", "i", "it's", "a"], ["x", "y"], ["a", "b", "a", "b", "a"]]
    want = Counter(tuple((w + [None, None])[k : k + 3]) for w in said for k in range(len(w)))
    assert {tuple(r)[1:4]: r["uses"] for r in ngrams(docs, 3).collect()} == want
