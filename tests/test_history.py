"""Undo logs in blocks against a loop."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpuskit.streaming import edits as E
from corpuskit.streaming import history as H


def loop(events, depth):
    done, undone = deque(maxlen=depth), []
    for op, value in events:
        E._replay_step(done, undone, op, value)
    return (done[-1] if done else None, len(done), len(undone))


@pytest.mark.parametrize("depth", [None, 1, 3, 20])
def test_logs_of_many_shapes(spark, depth, monkeypatch):
    monkeypatch.setattr(H, "SIZE", 7)
    rng = random.Random(5)
    logs, rows = {}, []
    for k in [None, *range(1, 40)]:
        weights = rng.choice([(1, 1, 1), (5, 1, 1), (1, 4, 1), (2, 2, 3), (1, 0, 0), (0, 1, 1)])
        ops = rng.choices(["do", "undo", "redo"], weights, k=rng.choice([1, 5, 60, 300]))
        logs[k] = [(op, float(i)) for i, op in enumerate(ops)]
        us = 0
        for i, (op, v) in enumerate(logs[k]):
            us += rng.choice([0, 1, 10 ** 9, 10 ** 12])
            rows.append((k, i, us, op, v))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, event_id bigint, us bigint, op string, value double").withColumn("ts", F.timestamp_micros("us"))
    got = {r.doc: (r.value, r.undo_depth, r.redo_depth) for r in E.replay(df, "doc", depth).collect()}
    assert got == {k: loop(v, depth) for k, v in logs.items()}


def test_empty_log_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "do", 2.0), (1, 2, "undo", None)], "block int, event_id bigint, op string, value double").withColumns(
        {"ts": F.timestamp_micros("event_id"), "grp": F.lit("x"), "at": F.lit("x"), "us": F.lit("x")}
    )
    assert [tuple(r) for r in E.replay(df, "block", None).collect()] == [(1, None, 0, 1)]
    assert E.replay(df.limit(0), "block", 5).columns == ["block", "value", "undo_depth", "redo_depth"]
    assert E.replay(df.limit(0), "block", 5).count() == 0
