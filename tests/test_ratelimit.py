"""The rate limit against a loop, and a hot key as even tasks."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.streaming import edits as E
from corpuskit.streaming import ratelimit as R


def loop(rows, wait):
    last, out = {}, set()
    for k, us, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if k not in last or us - last[k] >= wait:
            last[k] = us
            out.add(i)
    return out


def test_summaries_give_what_a_loop_gives():
    rng = random.Random(2)
    for _ in range(300):
        wait, slabs, run = rng.randint(1, 9), rng.randint(1, 4), rng.randint(1, 4)
        times = sorted(rng.randint(-40, 160) for _ in range(rng.randint(1, 60)))
        width = wait * slabs
        blocks = {}
        for t in times:
            blocks.setdefault(t // width, []).append(t)
        spans = {}
        for b in sorted(blocks):
            spans.setdefault(b // run, []).append((b, R.summary(blocks[b], wait, b * width)))
        got, before = [], R.NEVER
        for s in sorted(spans):
            parts = [p for _, p in spans[s]]
            for (b, _), t in zip(spans[s], R.walked(parts, wait, before), strict=True):
                got += [blocks[b][i] for i in R.passing(blocks[b], wait, t)]
            before = R.after(*R.combined(parts, wait, s * width * run), wait, before)
        want, last = [], None
        for t in times:
            if last is None or t - last >= wait:
                want.append(t)
                last = t
        assert got == want, (times, wait, slabs, run)


@pytest.mark.parametrize("seconds", [0.004, 1, 50])
def test_whole_result(spark, seconds, monkeypatch):
    monkeypatch.setattr(R, "SLABS", 3)
    monkeypatch.setattr(R, "RUN", 5)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 2, None]), rng.randint(0, 2_000) * 1_000_00 + rng.choice([0, 0, 7]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "user_id int, us long, event_id long").withColumn("ts", F.timestamp_micros("us")).repartition(6)
    got = E.rate_limit(df.withColumn("key", F.lit("x")), "user_id", seconds)
    assert got.columns == ["user_id", "us", "event_id", "ts", "key"]
    assert {r.event_id for r in got.collect()} == loop(rows, int(seconds * 1e6))
    assert E.rate_limit(df.limit(0), "user_id", seconds).count() == 0


def test_a_hot_key_is_many_groups(spark):
    """With 90 % of the rows in one key, no group of events holds a fiftieth of them."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("user_id"), F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") * 7).alias("ts"),
    )
    blocks = df.groupBy("user_id", F.floor(F.unix_micros("ts") / (60_000_000 * R.SLABS))).count()
    assert blocks.agg(F.max("count")).first()[0] < 400
    rows = [(r.user_id, r.event_id * 7_000_000, r.event_id) for r in df.select("user_id", "event_id").collect()]
    assert {r.event_id for r in E.rate_limit(df, "user_id", 60).collect()} == loop(rows, 60_000_000)
