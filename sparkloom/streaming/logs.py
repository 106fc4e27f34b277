"""Structured Streaming over append-only logs: rate limits, windows, decisions, idempotent import."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT, SECONDS = 1, 3600


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """An append-only folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def rate_verdicts(events: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """event_id, allowed, retry_after: the first ``limit`` hits of a user, type and window pass. Batch form."""
    bucket = F.floor(F.unix_timestamp("ts") / seconds)
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type", "bucket").orderBy("event_id"))
    e = events.select("event_id", "ts", "user_id", "event_type").withColumn("bucket", bucket).withColumn("nth", nth)
    allowed = F.col("nth") <= limit
    left = (F.col("bucket") + 1) * seconds - F.unix_timestamp("ts")
    return e.select("event_id", allowed.alias("allowed"), F.when(allowed, 0).otherwise(left).cast("long").alias("retry_after"))


def window_counts(events: DataFrame, watermark: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Hits by user, type and tumbling window; state past the watermark is dropped. Batch and stream alike."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), "user_id", "event_type")
        .agg(F.count("*").alias("hits"), F.count_if(F.lit(True)).alias("seen"))
        .select(F.col("w.start").alias("start"), "user_id", "event_type", "hits")
    )


_STATE = "pair long, newest long, approved long, decision string"


def fold_decisions(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A pair's newest review and newest approval so far; emitted whenever one arrives. The order is that of
    positions, not of arrival, so late records can't undo newer ones."""
    newest, approved, decision = state.get if state.exists else (-1, -1, None)
    for pdf in batches:
        reviews = pdf.loc[pdf["kind"] == "review", "position"]
        newest = max(newest, int(reviews.max()) if len(reviews) else -1)
        approvals = pdf[pdf["kind"] == "approval"]
        if len(approvals):
            last = approvals.loc[approvals["position"].idxmax()]
            if int(last["position"]) > approved:
                approved, decision = int(last["position"]), last["decision"]
    state.update((newest, approved, decision))
    yield pd.DataFrame({"pair": [key[0]], "newest": [newest], "approved": [approved], "decision": [decision]})


def stream_decisions(log: DataFrame) -> DataFrame:
    """The decision log (pair, position, kind, decision) as a stream of each pair's current standing."""
    return log.groupBy("pair").applyInPandasWithState(
        fold_decisions, _STATE, "newest long, approved long, decision string", "update", GroupStateTimeout.NoTimeout
    )


_LIVE_STATE = "newest long, approved long, decision string, until long"


def _fold_live(key, batches: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """As ``fold_decisions``, until no record of the pair has come for so long in event time."""
    if state.hasTimedOut:
        newest, approved, decision, _ = state.get
        state.remove()
        yield pd.DataFrame({"pair": [key[0]], "newest": [newest], "approved": [approved], "decision": [decision], "closed": [True]})
        return
    newest, approved, decision, until = state.get if state.exists else (-1, -1, None, 0)
    for pdf in batches:
        until = max(until, int(pdf["at_ms"].max()) + keep_ms)
        reviews = pdf.loc[pdf["kind"] == "review", "position"]
        newest = max(newest, int(reviews.max()) if len(reviews) else -1)
        approvals = pdf[pdf["kind"] == "approval"]
        if len(approvals):
            last = approvals.loc[approvals["position"].idxmax()]
            if int(last["position"]) > approved:
                approved, decision = int(last["position"]), last["decision"]
    state.update((newest, approved, decision, until))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"pair": [key[0]], "newest": [newest], "approved": [approved], "decision": [decision], "closed": [False]})


def live_decisions(log: DataFrame, late: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """Each pair's standing as it changes, and once more, ``closed``, when it has been still for ``keep_seconds``.

    ``log`` has pair, position, kind, decision and ts. Records later than the
    watermark allows are dropped; state lives as long as its pair is live, so
    it is as large as what came within that time, however long the stream runs.
    A record of a closed pair opens it anew, without what was known before.
    """
    timed = log.withWatermark("ts", late).withColumn("at_ms", (F.unix_micros("ts") / 1000).cast("long"))
    fold = partial(_fold_live, keep_ms=keep_seconds * 1000)
    columns = "pair long, newest long, approved long, decision string, closed boolean"
    return timed.groupBy("pair").applyInPandasWithState(fold, columns, _LIVE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def import_new(batch: DataFrame, target: str, key: str) -> int:
    """foreachBatch body: append the records of a grown file that ``target`` (a Parquet path) hasn't got. Returns how many."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(target)
    return n
