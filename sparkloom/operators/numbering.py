"""Global row numbers without a global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def numbered(df: DataFrame, order: str, name: str = "nth", within: str | None = None) -> DataFrame:
    """Rows with ``name`` from 1 in the order of a unique column, in all or within each value of a column.

    Ranges of the column are numbered apart and moved on by the counts of the
    ranges before; only the counts, one a range, come together, so neither the
    whole table nor a group that holds a third of it goes through one task. The ranges
    are written out: they are sampled, and would differ if they were made twice.
    """
    spark = df.sparkSession
    groups = [within] if within else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(*groups, order)
    ranged = checkpointed(narrow.repartitionByRange(parts, *groups, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part")
    before = counts.select(*[F.col(g).alias("_of") for g in groups], F.col("_part").alias("_at"), (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(order))
    same = F.col("_part") == F.col("_at")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col("_of"))
    placed = ranged.withColumn("_nth", nth).join(before, same).select(order, (F.col("_before") + F.col("_nth")).alias(name))
    return placed if set(df.columns) == {order} else df.join(placed, order)
