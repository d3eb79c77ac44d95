"""Keyed state over streams that read files, each query run until its input is used up."""

from __future__ import annotations

import datetime as dt

from itemloom.streaming import state

START = dt.datetime(2026, 3, 2, 10)


def stream(spark, folder, rows, schema):
    """A stream of one file a row, in the rows' order."""
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"file://{folder}/in")


def drained(spark, folder, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_a_task_runs_once(spark, tmp_path):
    tasks = stream(spark, tmp_path, [("parse", 1, at(0)), ("parse", 1, at(5)), ("commit", 1, at(6))], "kind string, id long, at timestamp")
    assert sorted((r.kind, r.id) for r in drained(spark, tmp_path, state.once(tasks, ["kind", "id"], "at"), "once")) == [("commit", 1), ("parse", 1)]


def test_attempts_of_a_window_that_the_first_opens(spark, tmp_path):
    rows = [("a", at(m), ok) for m, ok in ((0, False), (1, False), (2, False), (14, False), (15, False), (16, True), (17, False))]
    batch = spark.createDataFrame(rows, "key string, at timestamp, ok boolean")
    want = [True, True, False, False, True, True, True]
    assert [r.allowed for r in state.throttle(batch, "key", "at", "ok", 2).orderBy("at").collect()] == want
    live = stream(spark, tmp_path, rows, "key string, at timestamp, ok boolean")
    got = drained(spark, tmp_path, state.throttle(live, "key", "at", "ok", 2), "throttle")
    assert [r.allowed for r in sorted(got, key=lambda r: r["at"])] == want


def test_only_changes_are_sent(spark, tmp_path):
    rows = [("a", at(0), "x"), ("a", at(1), "x"), ("a", at(2), "y"), ("b", at(0), "x"), ("a", at(3), "x")]
    want = {("a", at(0), "x"), ("a", at(2), "y"), ("b", at(0), "x"), ("a", at(3), "x")}
    schema = "key string, at timestamp, value string"
    assert {tuple(r) for r in state.changes(spark.createDataFrame(rows, schema), "key", "at", "value").collect()} == want
    assert {tuple(r) for r in drained(spark, tmp_path, state.changes(stream(spark, tmp_path, rows, schema), "key", "at", "value"), "changes")} == want


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    write = state.apply_once(f"file://{tmp_path}/out")
    batch = spark.range(3)
    for number in (0, 1, 1):
        write(batch, number)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 6
