"""Lexical retrieval: a token table, BM25 in closed form, tiered lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_word, words
from .lineage import checkpointed

K1, B = 1.2, 0.75
#: Terms up to which they are broadcast.
BROADCAST_ROWS = 1 << 17


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, length): lower-case words of each document, where it lies. Nothing is shuffled."""
    w = docs.select(key, F.transform(words(F.col(text)), F.lower).alias("words"))
    return w.withColumn("length", F.size("words"))


def bm25(index: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """(query, key, score) of every document with a term of a query; ``asked`` has (query, term).

    Words that nobody asks for are dropped before anything is counted or
    shuffled. The texts are read once: the empty term, which no word is, stands
    for the documents' number and mean length. Words may be as they are written.
    """
    terms = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "term string"))
    asked = checkpointed(asked.select("query", "term").distinct())
    small = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda rows: rows
    said = index.where("length > 0").select(key, "length", F.explode(F.array_append("words", F.lit(""))).alias("term")).withColumn("term", F.lower("term"))
    met = checkpointed(said.join(small(terms), "term").groupBy(key, "term", "length").agg(F.count("*").alias("tf")))
    stats = met.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).alias("mean"))
    hit = met.where("term <> ''")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # A document's words come together before they meet the queries: its scores are summed there, and no pair of both travels.
    scored = hit.join(small(df), "term").crossJoin(F.broadcast(stats)).select(key, "term", weight.alias("weight")).repartition(key)
    return scored.join(small(asked), "term").groupBy("query", key).agg(F.sum("weight").alias("score"), F.count("*").alias("met"))


def term_weights(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, idf, mean) of every asked term that a document has: counted in one pass over the words, where they lie.

    mean is the mean length of all documents that have words.
    """
    # No word is empty, so the empty term stands for all documents.
    terms = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "term string"))
    said = index.where("length > 0").select("length", F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("term"))
    counts = checkpointed(said.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("sum")))
    stats = counts.where("term = ''").select(F.col("df").alias("n"), (F.col("sum") / F.col("df")).alias("mean"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts.where("term <> ''").crossJoin(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "mean")


def covering(index: DataFrame, key: str, weights: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, score) with all columns of ``index`` for every document that has all terms of a query, by BM25.

    ``asked`` has (query, term), each once; ``weights`` are those of its terms.
    Documents meet a query by its rarest term and are scored where they lie;
    only the queries travel.
    """
    known = asked.join(weights, "term", "left").groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("df", "term", "idf", "mean"))).alias("terms"), F.count("*").alias("k"), F.count("df").alias("there")
    )
    queries = checkpointed(known.where("k = there").select("query", "terms", F.col("terms")[0]["term"].alias("rarest")))
    met = index.withColumn("rarest", F.explode(F.array_distinct("words"))).join(F.broadcast(queries), "rarest").drop("rarest")
    met = met.where(F.forall("terms", lambda x: F.array_contains("words", x["term"])))

    def weight(x: Column) -> Column:
        tf = F.size(F.filter("words", lambda w: w == x["term"]))
        return x["idf"] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / x["mean"]))

    return met.withColumn("score", F.aggregate(F.transform("terms", weight), F.lit(0.0), lambda a, x: a + x)).drop("terms")


def tiered(entries: DataFrame, key: str, headword: Column, asked: Column) -> Column:
    """Where an entry stands for a query: 0 exact, 1 prefix, 2 whole word, 3 substring; null no match."""
    return (
        F.when(headword == asked, 0)
        .when(headword.startswith(asked), 1)
        .when(F.array_contains(F.split(headword, " "), asked), 2)
        .when(F.contains(headword, asked), 3)
    )


def query_terms(text: str) -> tuple[list[str], bool]:
    """Terms of a search box: operators dropped, the last is a prefix unless a space follows."""
    kept = ["".join(c for c in piece if c not in "\"*():^") for piece in text.split()]
    kept = [p for p in kept if any(c.isalnum() for c in p)]
    return kept, bool(kept) and not text.endswith(" ")


def exact_forms(text: str) -> list[str]:
    """A text's bare lower-case form, and with each closing mark."""
    bare = text.strip().lower().rstrip(".!? ")
    return [bare, *(bare + mark for mark in ".!?")]


def top(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n of each group with their rank; each task keeps n before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", nth.cast("long")).where(F.col("place") <= n)


__all__ = ["bm25", "covering", "exact_forms", "normalize_word", "query_terms", "term_weights", "tiered", "tokens", "top"]
