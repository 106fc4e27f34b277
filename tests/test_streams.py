"""State that ends: pairs are closed when they are still, and late records of closed ones are defined."""

import datetime
import os
import time

from sparkloom.streaming.logs import live_decisions

SCHEMA = "pair long, position long, kind string, decision string, ts timestamp"


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


def test_state_is_bounded_and_closed_pairs_open_anew(spark, tmp_path):
    batches = [
        [(1, 5, "review", None, at(0)), (1, 7, "approval", "approve", at(0)), (2, 6, "review", None, at(0))],
        [(2, 9, "approval", "reject", at(20)), (3, 10, "review", None, at(20))],
        [(k, 100 + k, "review", None, at(200)) for k in range(10, 15)],  # the watermark moves on: what is still is closed
        [(20, 200, "review", None, at(201))],
        [(1, 8, "review", None, at(201)), (2, 4, "review", None, at(3))],  # pair 1 opens anew; pair 2's record is too late
    ]
    folder, seen, states = str(tmp_path / "log"), [], []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
        name = next(f for f in os.listdir(f"{tmp_path}/part{i}") if f.endswith(".parquet"))
        os.makedirs(folder, exist_ok=True)
        os.rename(f"{tmp_path}/part{i}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (time.time() - 100 + i,) * 2)
    log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = live_decisions(log, "1 hour", 24 * 3600).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect())))
    running = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"]]
    closed = {r[0]: r[1:4] for r in seen if r[4]}
    assert closed[1] == (5, 7, "approve") and closed[2] == (6, 9, "reject") and closed[3] == (10, -1, None)
    assert [r[1:] for r in seen if r[0] == 1 and not r[4]] == [(5, 7, "approve", False), (8, -1, None, False)]
    assert not any(r[0] == 2 and r[1] == 4 for r in seen)
    # Seven pairs at the end, of the ten that came: the three still ones are gone, one of them has come back.
    assert states[-1] == 7 and max(states) <= 9
