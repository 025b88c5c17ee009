"""Time-shaped behaviour on event logs: batch forms and their Structured Streaming twins.

Events: doc_id (or another key), ts TIMESTAMP, event_id and what else rides along. Late rows
beyond the watermark are dropped by Spark and counted in its progress metrics.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.operators.ordered import keep_parallel, previous_values, running_sums, top_per_key
from corpuskit.streaming.history import replayed
from corpuskit.streaming.ratelimit import rate_limited

WATERMARK = "10 minutes"
DAY = 86_400_000_000


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Add ``session_no`` per key: a new one after a pause longer than the gap.

    Blocks of one day keep a key with most of the events from ending in one task. Events of one
    time go by event_id, in both steps.
    """
    e = events.withColumn("_us", micros())
    tie = ("event_id",)
    p = previous_values(e, [key], "_us", {"_before": "_us"}, DAY, tie)
    new = F.coalesce(F.col("_us") - F.col("_before") > gap_seconds * 1e6, F.lit(False))
    flagged = p.withColumn("_new", new.cast("bigint"))
    return running_sums(flagged, [key], "_us", {"session_no": F.col("_new")}, DAY, tie=tie).drop("_us", "_before", "_new")


def coalesce_edits(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """One log entry per burst of edits."""
    return sessions(events, key, gap_seconds).groupBy(key, "session_no").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("edits")
    ).drop("session_no")


def coalesce_edits_stream(events: DataFrame, key: str, gap: str, watermark: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), key).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("edits")
    ).drop("session_window")


def debounce(events: DataFrame, key: str, quiet_seconds: float = 0.5) -> DataFrame:
    """Only the last event of each burst."""
    last = F.max_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("e")
    return sessions(events, key, quiet_seconds).groupBy(key, "session_no").agg(last).select("e.*")


def debounce_stream(events: DataFrame, key: str, quiet: str = "500 milliseconds", watermark: str = WATERMARK) -> DataFrame:
    last = F.max_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("e")
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", quiet), key).agg(last).select(
        key, "e.ts", "e.event_id"
    )


def rate_limit(events: DataFrame, key: str, seconds: float = 60) -> DataFrame:
    """Events that are at least ``seconds`` after the last one let through, per key.

    Which events pass depends on the ones before; stretches of time are summed up side by side, so a
    key with most of the events is many even tasks.
    """
    return rate_limited(events.withColumn("_us", micros()), key, "event_id", "_us", seconds).drop("_us")


def rate_limit_stream(events: DataFrame, key: str, seconds: float = 60, watermark: str = WATERMARK) -> DataFrame:
    """The streaming form; its state is one time stamp per key, and goes when long unused."""
    wait = int(seconds * 1e6)

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        last = state.get[0] if state.exists else None
        keep = []
        for us in pdf["us"]:
            passes = last is None or us - last >= wait
            last = us if passes else last
            keep.append(passes)
        state.update((int(last),))
        idle = max(int(last + wait) // 1000, state.getCurrentWatermarkMs()) + 1
        state.setTimeoutTimestamp(idle)
        yield pdf.loc[keep, [key, "event_id", "us"]].reset_index(drop=True)

    # event time, not the clock, ends unused state, so a finished replay really ends
    e = events.withWatermark("ts", watermark).select(key, "event_id", "ts", micros().alias("us"))
    out = f"{key} {dict(e.dtypes)[key]}, event_id bigint, us bigint"
    return e.groupBy(key).applyInPandasWithState(step, out, "us bigint", "append", GroupStateTimeout.EventTimeTimeout)


def expire(arrivals: DataFrame, pickups: DataFrame, key: str, seconds: float = 600) -> DataFrame:
    """Arrivals nobody picked up within the time (key, ts, event_id).

    Arrivals and pickups meet by key and by time bucket of the limit's length (a pickup counts
    for its own bucket and the one before), so a busy key is many small groups.
    """
    size = int(seconds * 1e6)
    a = arrivals.select(key, "event_id", "ts", micros().alias("_a")).withColumn("_b", F.floor(F.col("_a") / size))
    p = pickups.select(key, micros().alias("_p"))
    p = p.withColumn("_b", F.explode(F.array(F.floor(F.col("_p") / size), F.floor(F.col("_p") / size) - 1))).alias("p")
    aa = a.alias("a")
    on = (
        F.col(f"a.{key}").eqNullSafe(F.col(f"p.{key}")) & (F.col("a._b") == F.col("p._b"))
        & (F.col("p._p") >= F.col("a._a")) & (F.col("p._p") <= F.col("a._a") + size)
    )
    return aa.join(p, on, "left_anti").select(key, "event_id", "ts")


def expire_stream(arrivals: DataFrame, pickups: DataFrame, key: str, limit: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    a = arrivals.select(F.col(key).alias("a_key"), "event_id", F.col("ts").alias("a_ts")).withWatermark("a_ts", watermark)
    p = pickups.select(F.col(key).alias("p_key"), F.col("ts").alias("p_ts")).withWatermark("p_ts", watermark)
    on = F.expr(f"a_key = p_key AND p_ts >= a_ts AND p_ts <= a_ts + interval {limit}")
    return a.join(p, on, "leftOuter").filter("p_key IS NULL").select(F.col("a_key").alias(key), "event_id", F.col("a_ts").alias("ts"))


def bounded_history(log: DataFrame, key: str, per_key: int, total: int) -> DataFrame:
    """The newest entries: at most ``per_key`` per document and ``total`` in all."""
    newest = [F.desc("ts"), F.desc("event_id")]
    return top_per_key(log, [key], newest, per_key, "event_id").orderBy(*newest).limit(total)


def bounded_history_stream(log: DataFrame, key: str, per_key: int) -> DataFrame:
    """The streaming form, first half: the newest ``per_key`` entries of every key that had events in a batch.

    Rows: ``key``, event_id, us. The state of a key is these entries, in any order of arrival; a key that
    held more never does again.
    """
    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids = state.get if state.exists else ((), ())
        held = sorted({*zip(times, ids), *((int(u), int(i)) for b in batches for u, i in zip(b["us"], b["event_id"]))})[-per_key:]
        state.update(([u for u, _ in held], [i for _, i in held]))
        yield pd.DataFrame({key: [keys[0]] * len(held), "event_id": [i for _, i in held], "us": [u for u, _ in held]})

    e = log.select(key, "event_id", micros().alias("us"))
    return e.groupBy(key).applyInPandasWithState(
        step, f"{key} {dict(e.dtypes)[key]}, event_id bigint, us bigint", "times array<bigint>, ids array<bigint>", "update",
        GroupStateTimeout.NoTimeout,
    )


def merge_history(batch: DataFrame, number: int, folder: str, key: str, total: int) -> None:
    """The streaming form, second half, for ``foreachBatch``: the newest ``total`` entries of all keys.

    A batch brings whole new lists of its keys, which replace what the store has of them. What falls out of
    the store never comes back, as a list only drops an entry for a newer one, so ``total`` rows are
    enough. Two folders take turns, so a batch that is run again reads the same store as before.
    """
    spark = batch.sparkSession
    new = batch.select(key, "event_id", "us")
    if number:
        old = spark.read.schema(new.schema).parquet(f"{folder}/{(number - 1) % 2}")
        new = new.unionByName(old.join(batch.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))
    new.orderBy(F.desc("us"), F.desc("event_id")).limit(total).write.mode("overwrite").parquet(f"{folder}/{number % 2}")


def history_of(spark, folder: str, last: int, key_type: str, key: str) -> DataFrame:
    """The stored entries after batch ``last``."""
    return spark.read.schema(f"{key} {key_type}, event_id bigint, us bigint").parquet(f"{folder}/{last % 2}")


def progress(notes: DataFrame) -> DataFrame:
    """Counts by kind; on a stream use update or complete mode."""
    return notes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _replay_step(done: deque, undone: list, op: str, value) -> None:
    if op == "undo":
        if done:
            undone.append(done.pop())
    elif op == "redo":
        if undone:
            done.append(undone.pop())
    else:
        done.append(value)
        undone.clear()


def replay(log: DataFrame, key: str, depth: int | None) -> DataFrame:
    """State per document after its do / undo / redo events (op, value) in time order.

    A new edit clears what could be redone; at most ``depth`` steps can be undone (None: all). Blocks of a
    document's log are summed up side by side, so one with most of the events is many even tasks.
    """
    return replayed(log.withColumn("_us", micros()), key, "_us", "event_id", "op", "value", depth, DAY)


def replay_stream(log: DataFrame, key: str, depth: int | None) -> DataFrame:
    """The streaming form: the newest state of every document that had events in a batch."""
    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [])
        done, undone = deque(old[0], maxlen=depth), list(old[1])
        pdf = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for op, value in zip(pdf["op"], pdf["value"]):
            _replay_step(done, undone, op, float(value))
        state.update((list(done), undone))
        yield pd.DataFrame({
            key: [keys[0]], "value": [done[-1] if done else None], "undo_depth": [len(done)], "redo_depth": [len(undone)],
        })

    e = log.select(key, "event_id", micros().alias("us"), "op", F.col("value").cast("double").alias("value"))
    out = f"{key} {dict(e.dtypes)[key]}, value double, undo_depth bigint, redo_depth bigint"
    return e.groupBy(key).applyInPandasWithState(
        step, out, "done array<double>, undone array<double>", "update", GroupStateTimeout.NoTimeout
    )
