"""Keyed state over event streams: once-only tasks, progress, presence, throttling, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(tasks: DataFrame, keys: list[str], at: str, keep: str = "7 days") -> DataFrame:
    """Each task once within the time its mark is kept; works on streams and batches."""
    if not tasks.isStreaming:
        return tasks.dropDuplicates(keys)
    return tasks.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)


def progress(events: DataFrame, key: str, at: str, stage: str, percent: str) -> DataFrame:
    """(key, stage, percent) of a batch of events: the latest stage, and progress that never falls back."""
    return events.groupBy(key).agg(F.max_by(stage, F.struct(at, stage)).alias("stage"), F.max(percent).alias("percent"))


def presence(events: DataFrame, user: str, at: str) -> DataFrame:
    """(user, last_seen), which never moves back; update mode on streams."""
    return events.groupBy(user).agg(F.max(at).alias("last_seen"))


def online(last_seen: DataFrame, now, seconds: int = 90) -> DataFrame:
    """Seen at most so many seconds ago, the bound included."""
    return last_seen.where(F.col("last_seen") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"))


def throttle(attempts: DataFrame, key: str, at: str, success: str, most: int, minutes: int = 15) -> DataFrame:
    """(key, at, allowed): at most ``most`` attempts in a window that the first one opens; success resets.

    The window is anchored at a key's first attempt, so it is state and not a tumbling window.
    """
    width = minutes * 60.0
    if not attempts.isStreaming:
        seq = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, success))).alias("a"))  # bounded by a key's attempts
        start = F.struct(F.lit(None).cast("timestamp").alias("begun"), F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("ok"))

        def fold(s, x):
            fresh = F.coalesce((s["used"] == 0) | (x[at] >= s["begun"] + F.expr(f"INTERVAL {minutes} MINUTES")), F.lit(True))
            used = F.when(fresh, 0).otherwise(s["used"])
            allowed = used < most
            return F.struct(F.when(fresh, x[at]).otherwise(s["begun"]).alias("begun"), F.when(allowed & x[success], 0).otherwise(used + 1).alias("used"), F.concat(s["ok"], F.array(allowed)).alias("ok"))

        folded = seq.select(key, "a", F.aggregate("a", start, fold, lambda s: s["ok"]).alias("ok"))
        return folded.select(key, F.explode(F.arrays_zip("a", "ok")).alias("z")).select(key, F.col(f"z.a.{at}").alias(at), F.col("z.ok").alias("allowed"))

    def step(state_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, used = state.get if state.exists else (0.0, 0)
        rows = []
        events = pd.concat(list(frames)).sort_values(at, kind="stable")
        for when, ok in zip(events[at], events[success]):
            t = when.timestamp()
            if not used or t >= begun + width:
                begun, used = t, 0
            allowed = used < most
            used += 1
            if allowed and ok:
                used = 0
            rows.append((state_key[0], when, allowed))
        state.update((begun, used))
        yield pd.DataFrame(rows, columns=[key, at, "allowed"])

    kind = attempts.schema[key].dataType.simpleString()
    return attempts.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{at}` timestamp, allowed boolean", "begun double, used int", "append", GroupStateTimeout.NoTimeout)


def changes(snapshots: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Snapshots that differ from the key's one before, of a stream or a batch."""
    if not snapshots.isStreaming:
        w = Window.partitionBy(key).orderBy(at)
        last, first = F.lag(value).over(w), F.row_number().over(w) == 1
        return snapshots.withColumn("__new", first | ~F.col(value).eqNullSafe(last)).where("__new").select(key, at, value)

    def step(state_key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        events = pd.concat(list(frames)).sort_values(at, kind="stable")
        keep = []
        for v in events[value]:
            keep.append(v != last)
            last = v
        state.update((last,))
        yield events[keep][[key, at, value]]

    types = {f.name: f.dataType.simpleString() for f in snapshots.schema}
    schema = f"`{key}` {types[key]}, `{at}` {types[at]}, `{value}` {types[value]}"
    return snapshots.groupBy(key).applyInPandasWithState(step, schema, f"last {types[value]}", "append", GroupStateTimeout.NoTimeout)


def claim(attempts: DataFrame, key: str, at: str, hours: int = 24) -> DataFrame:
    """Attempts that win the claim of their interval: the first of each key, and the first so many hours after a winner."""
    seq = attempts.groupBy(key).agg(F.array_sort(F.collect_list(at)).alias("a"))
    gap = F.expr(f"INTERVAL {hours} HOURS")
    start = F.array().cast("array<timestamp>")
    won = F.aggregate("a", start, lambda s, t: F.when((F.size(s) == 0) | (t >= F.try_element_at(s, F.lit(-1)) + gap), F.concat(s, F.array(t))).otherwise(s))
    return seq.select(key, F.explode(won).alias(at))


def apply_once(folder: str):
    """A function for foreachBatch that writes each batch to a place named by its number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
