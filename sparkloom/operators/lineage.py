"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Narrow rows (ids, hashes) that a task takes before another one is worth its while.
PER_TASK = 1 << 17


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder in the warehouse where that is unset; both are seen by all machines."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder, and read from there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks so many narrow rows need: one for each ``PER_TASK``, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PER_TASK))
