"""Exact and best-of dedup, splits, holdouts and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed

HELD_OUT = ("validation", "test")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. One aggregation that combines before its shuffle, so a hot key doesn't matter."""
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return picked.select(*keys, "_first.*").select(*df.columns)


def keep_best(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The row with the highest score of each key, the first of equals."""
    ranked = df.withColumn("_less", -F.col(score))
    picked = ranked.groupBy(*keys).agg(F.min(F.struct("_less", order, *[c for c in df.columns if c not in keys and c != order])).alias("_best"))
    return picked.select(*keys, "_best.*").drop("_less").select(*df.columns)


def nth_identical(df: DataFrame, content: list[str], order: str) -> Column:
    """How many identical earlier records a record has."""
    return F.row_number().over(Window.partitionBy(*content).orderBy(order)) - 1


def nearest_rank(values: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of percentiles by nearest rank, the index half-even rounded.

    Distinct values with their counts are ranked, by range: each partition of
    the sorted values knows only its own rows and the totals before it, so no
    task sees them all.
    """
    spark = values.sparkSession
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written out: ranges are sampled, and would differ if they were made twice.
    ranged = checkpointed(counts.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    before = totals.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy(value))
    placed = ranged.join(F.broadcast(before), "part").select(value, (F.col("before") + running).alias("upto"))
    total = totals.agg(F.sum("rows").alias("total"))
    picks = [
        F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("total") - 1)), F.col(value))).alias(name) for name, f in fractions.items()
    ]
    return placed.crossJoin(F.broadcast(total)).agg(*picks)
