"""Scoring of hypotheses against references."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..operators.lineage import checkpointed
from ..sources.views import table
from .registry import query


def _hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as references; two systems: one drops every seventh word, the other every third."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("reference"), F.split("text", " ").alias("w"))
    drop = lambda n: F.array_join(F.filter("w", lambda x, i: (i + 1) % n != 0), " ")
    return b.select("item_id", "reference", drop(7).alias("close"), drop(3).alias("far"))


def _stats(spark: SparkSession, sf: str, system: str) -> DataFrame:
    return scoring.statistics(_hypotheses(spark, sf), "item_id", system, "reference").select(F.lit(system).alias("system"), "item_id", "stats")


@query()
def chrf_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """chrF++ and BLEU of each system: statistics are summed on the executors, the formula sees one row a system."""
    both = _stats(spark, sf, "close").unionByName(_stats(spark, sf, "far"))
    width = 3 * (scoring.CHAR_ORDER + scoring.BLEU_ORDER)
    sums = both.groupBy("system").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)], F.count("*").alias("n")).collect()
    rows = [(r["system"], r["n"], scoring.chrf(np.array(r[1 : width + 1])), scoring.bleu(np.array(r[1 : width + 1]))) for r in sums]
    return spark.createDataFrame(rows, "system string, sentences long, chrf double, bleu double")


@query(
    """WITH h AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS r, regexp_extract_all(array_to_string(list_transform(list_filter(list_zip(string_split(text, ' '), range(1, len(string_split(text, ' ')) + 1)), lambda x: x[2] % 7 <> 0), lambda x: x[1]), ' '), '[\\p{L}\\p{N}]+') AS h FROM benchmark)
SELECT item_id, len(h) AS hypothesis_words, len(r) AS reference_words, (SELECT coalesce(sum(least(a.n, b.n)), 0)::BIGINT FROM (SELECT w, count(*) AS n FROM (SELECT unnest(h.h) AS w) GROUP BY w) a JOIN (SELECT w, count(*) AS n FROM (SELECT unnest(h.r) AS w) GROUP BY w) b USING (w)) AS matched FROM h"""
)
def word_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The word counts that BLEU's first order is made of."""
    at = 3 * scoring.CHAR_ORDER
    s = _stats(spark, sf, "close")
    return s.select("item_id", F.col("stats")[at].alias("hypothesis_words"), F.col("stats")[at + 1].alias("reference_words"), F.col("stats")[at + 2].alias("matched"))


RESAMPLES = 1000


@query()
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """95 % intervals over a thousand resamples, and the one-sided paired test that the far system is as good.

    Resamples are summed on the executors; the driver sees one vector for each system and resample.
    """
    both = checkpointed(_stats(spark, sf, "close").unionByName(_stats(spark, sf, "far")))
    width = 3 * (scoring.CHAR_ORDER + scoring.BLEU_ORDER)
    sums = {r[0]: scoring.chrf(np.array(r[1:])) for r in both.groupBy("system").agg(*[F.sum(F.col("stats")[i]) for i in range(width)]).collect()}
    scores: dict[str, np.ndarray] = {name: np.zeros(RESAMPLES) for name in sums}
    for r in scoring.resampled(both, "item_id", RESAMPLES).collect():
        scores[r["system"]][r["resample"]] = scoring.chrf(np.array(r["sums"]))
    worse = float(np.mean(scores["close"] <= scores["far"])) if len(scores) == 2 else 1.0
    rows = [(name, sums[name], *np.percentile(scores[name], [2.5, 97.5]).tolist(), worse) for name in sorted(sums)]
    return spark.createDataFrame(rows, "system string, chrf double, low double, high double, p_value double")


@query()
def promotion_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = {r["system"]: r.asDict() for r in bootstrap_ci(spark, sf).collect()}
    passed = scoring.gate(rows["close"], [rows["far"]])
    return spark.createDataFrame([("close", "far", passed)], "candidate string, baseline string, passed boolean")


@query(
    """SELECT coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS items FROM labels GROUP BY GROUPING SETS ((quality), (toxic), (quality, toxic), ())"""
)
def eval_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the rated set by each rating and in all (-1: over all values)."""
    c = F.col
    g = table(spark, sf, "labels").groupingSets([[c("quality")], [c("toxic")], [c("quality"), c("toxic")], []], c("quality"), c("toxic")).agg(F.count("*").alias("items"))
    return g.select(F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "items")
