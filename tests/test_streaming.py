from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from quarryline.streaming.rollup import MetricsSink, listen, minute_rollup, notify, stream, windowed


def test_stream_of_events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=20 * k), "click" if k % 2 else "view", float(k)) for k in range(12)]
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").repartition(2).write.parquet(folder)
    source = stream(spark, folder, spark.read.parquet(folder).schema)
    seen = []
    query = listen(source, "click", lambda df, n: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "c1"), every=None)
    query.awaitTermination()
    assert sorted(seen) == [1, 3, 5, 7, 9, 11]
    query = windowed(source, ["event_type"], "value").writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("minutes").agg(F.sum("n")).first()[0] == 12


def test_listener_stays_up(spark, tmp_path):
    import time

    folder = str(tmp_path / "events")
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "jobs", 1.0)], schema).write.parquet(folder)
    seen = []
    query = listen(stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=100), "jobs", lambda df, n: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "c"), every="100 milliseconds")
    try:
        for event, channel in ((2, "jobs"), (3, "other"), (4, "jobs")):
            notify(spark, folder, channel, event_id=event, value=0.0)
        until = time.monotonic() + 60
        while len(seen) < 3 and time.monotonic() < until:
            time.sleep(0.1)
        assert query.isActive and sorted(seen) == [1, 2, 4]
    finally:
        query.stop()


def test_metrics_sink_merges_late_minutes(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=10 * k), "a" if k % 2 else "b", float(k), k % 5 == 0) for k in range(24)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, action string, duration double, failed boolean")
    whole = {(r["minute"], r["action"]): r for r in minute_rollup(events, ["action"], "duration", "failed").collect()}
    sink = MetricsSink(spark, str(tmp_path / "metrics"), ["action"])
    for part in (events.where("duration < 8"), events.where("duration >= 8")):
        sink.flush(minute_rollup(part, ["action"], "duration", "failed"))
    got = {(r["minute"], r["action"]): r for r in sink.read().collect()}
    assert got.keys() == whole.keys()
    for key, r in whole.items():
        assert (got[key]["n"], got[key]["errors"]) == (r["n"], r["errors"]) and abs(got[key]["mean"] - r["mean"]) < 1e-9
    assert all(got[k]["p99"] == r["p99"] for k, r in whole.items())  # the later flush had the longest
    old = MetricsSink(spark, str(tmp_path / "old"), ["action"], days=30)
    old.flush(minute_rollup(events, ["action"], "duration"))
    assert old.read().count() == 0
    near = minute_rollup(events, ["action"], "duration", approximate=1000).collect()
    assert {(r["minute"], r["action"]): r["p95"] for r in near} == {k: r["p95"] for k, r in whole.items()}
