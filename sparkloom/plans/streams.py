"""Stream operators as queries: batch twins with oracles, and replays of the log as a stream."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed, shared_folder
from ..sources.views import SQL, decision_log, table
from ..streaming.logs import rate_verdicts, stream_decisions, window_counts
from .registry import query


def _replay(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its sink as a table; state and sink lie in the shared folder until it has ended."""
    at = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        running.awaitTermination()
        return checkpointed(spark.read.parquet(f"{at}/out"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@query(
    """SELECT event_id, nth <= 1 AS allowed, CASE WHEN nth <= 1 THEN 0 ELSE (b + 1) * 3600 - s END::BIGINT AS retry_after FROM (
  SELECT event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts) / 3600)::BIGINT AS b, row_number() OVER (PARTITION BY user_id, event_type, floor(epoch(ts) / 3600) ORDER BY event_id) AS nth FROM events)"""
)
def rate_limit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return rate_verdicts(table(spark, sf, "events"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, event_type, count(*) AS hits FROM events GROUP BY ALL")
def rate_limit_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = window_counts(table(spark, sf, "events"))
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""WITH {SQL["decision_log"]} SELECT pair, coalesce(max(position) FILTER (kind = 'review'), -1) AS newest, coalesce(max(position) FILTER (kind = 'approval'), -1) AS approved,
  arg_max(decision, position) FILTER (kind = 'approval') AS decision FROM decision_log GROUP BY pair"""
)
def stream_decision_state(spark: SparkSession, sf: str) -> DataFrame:
    """The log replayed as a stream with state; each pair's last state."""
    events = table(spark, sf, "events")
    # A file source watches folders; a table that is one file is found in its folder by name.
    files = events.inputFiles()
    one = len(files) == 1 and files[0].endswith("/events.parquet")
    source = spark.readStream.schema(events.schema)
    stream = source.option("pathGlobFilter", "events.parquet").parquet(sf) if one else source.parquet(f"{sf}/events.parquet")
    log = decision_log(stream).select("pair", "position", "kind", "decision")
    out = _replay(spark, stream_decisions(log), "update")
    return out.groupBy("pair").agg(F.max_by(F.struct("newest", "approved", "decision"), "batch").alias("s")).select("pair", "s.*")

