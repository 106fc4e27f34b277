"""What several of the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components  # noqa: F401 - shared with the operators
from ..operators.memory import frugal, give_back, release_memory  # noqa: F401 - shared with the operators
from ..sources.views import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents and conversations are spread over the cores where they are small, see ``spread``."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations") else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as a compressed table in the shared folder, and what deletes it once no result reads it any more."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/sparkloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)

    def drop() -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(at), drop


#: Rows of doc_id and hash up to which a side is broadcast.
BROADCAST_ROWS = 1 << 17


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, by ``decided``: doc_id, raw (XXH64 of the text), n, kept.

    Of ``n`` rows alike one stays. Decisions that change nothing are left out;
    where the others are few they go to the texts, else the texts move once to meet them.
    """
    placed = materialize(
        decided.where("n > 1 OR NOT kept").select(
            F.coalesce("doc_id", F.lit(0)).alias("_loom_id"), F.col("doc_id").isNull().alias("_loom_none"), F.col("raw").alias("_loom_raw"), "n", "kept"
        ).withColumnsRenamed({"n": "_loom_n", "kept": "_loom_kept"})
    )
    keys = ["_loom_id", "_loom_none", "_loom_raw"]
    doc_id = F.col("doc_id").cast("long")
    hashed = docs.withColumns({"_loom_id": F.coalesce(doc_id, F.lit(0)), "_loom_none": doc_id.isNull(), "_loom_raw": F.xxhash64("text")})
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    if placed.count() <= BROADCAST_ROWS:
        stay = hashed.join(F.broadcast(placed.select(*keys)), keys, "left_anti").select(*docs.columns)
        repeated = placed.where("_loom_kept").select(*keys)
        if repeated.isEmpty():
            return stay
        once = hashed.join(F.broadcast(repeated), keys, "left_semi").withColumn("_loom_nth", nth).where("_loom_nth = 1")
        return stay.unionByName(once.select(*docs.columns))
    met = hashed.join(placed, keys, "left").where("_loom_kept IS NULL OR _loom_kept").withColumn("_loom_nth", nth)
    return met.where("_loom_nth = 1").select(*docs.columns)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a batch's texts, end to end, and the n+1 offsets; null counts as empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Byte table that lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
