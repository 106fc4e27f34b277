"""Connected components of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import checkpointed, tasks_for


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of (a, b) long pairs: rows (node, root), root the least node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until
    nothing moves: each is one aggregation by node and one join, no step
    gathers a neighbourhood, and the number of edges never grows. Nodes without
    an edge aren't returned. A step's stages have as many tasks as the edges
    need, however many partitions a shuffle has: each task of each step leaves files.
    """
    checksum = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = checksum(edges)
    tasks = tasks_for(pairs.sparkSession, seen[0])
    while True:
        both = edges.toDF("u", "v").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(tasks)
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.a", "e.b").where("a <> b").coalesce(tasks).distinct().coalesce(tasks))
        now = checksum(edges)
        if now == seen:
            return edges.toDF("node", "root")
        seen = now
