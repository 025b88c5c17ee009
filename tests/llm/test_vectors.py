"""Embedding links against brute force in double precision."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpuskit.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.98):
    """Rows (vec_id, embedding, label) to the contract's rows."""
    def fit(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    linked = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not fit(v) or not fit(w) or len(v) != len(w):
                continue
            x, y = (np.array(np.float32(z), np.float64) for z in (v, w))
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((r[0], len(linked[i]), first, first is not None and first == r[0]))
    return sorted(out, key=str)


def some_rows(rng, n, labels, dim=12):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        if rng.random() < 0.2 and rows:
            v = rng.choice(rows)[1]
        else:
            noise, scale = rng.choice([0.02, 0.1, 0.18, 0.3]), rng.choice([1, 1, 7])
            v = [float(np.float32((x + rng.gauss(0, noise)) * scale)) for x in c]
        rows.append((i, v, rng.choice(labels)))
    rng.shuffle(rows)
    return rows


def test_whole_result(spark, monkeypatch):
    monkeypatch.setattr(V, "TILE", 40)
    monkeypatch.setattr(V, "STRIP", 16)
    rows = some_rows(random.Random(1), 420, [1, 1, 1, 2, None])
    got = sorted(map(tuple, V.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = plain(rows)
    assert got == want
    assert sum(r[1] for r in want) > 500 and any(not r[3] for r in want)


def test_edges_repeats_and_clashing_columns(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 5), (1, one, 5), (None, one, 5), (None, [9.0, 0.0, 1.0], 5), (2, None, 5), (3, [], 5), (4, [0.0, 0.0, 0.0], 5),
        (5, [1.0, None, 3.0], 5), (6, [float("nan"), 1.0, 1.0], 5), (7, [float("inf"), 1.0, 1.0], 5), (8, one, None), (9, one, 6),
        (10, [2.0, 4.0, 6.0], 5), (11, [1.0, 2.0], 5), (12, [-0.0, 0.0, 1.0], 7), (13, [0.0, 0.0, 1.0], 7), (14, [3e38, 3e38, 3e38], 7),
        (15, [1e-38, 1e-38, 1e-38], 7), (8, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in "grp key n raw row links root u v n_links component_id kept dim pos total tile".split():
        df = df.withColumn(c, F.lit("x"))
    got = sorted(map(tuple, V.near_vectors(df).collect()), key=str)
    assert got == plain(rows)
    assert V.near_vectors(df.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    for dim in (3, 64, 1500):
        rows = rng.normal(size=(300, dim)).astype(np.float32)
        x, length = V.scaled(rows)
        q, scale, rest = V.quantised(x, length)
        exact = (x / length[:, None]) @ (x / length[:, None]).T
        rough = V.products(q, q) * scale[:, None] * scale[None, :]
        assert (np.abs(exact - rough) <= (1 + rest[:, None]) * (1 + rest[None, :]) - 1 + 1e-6).all()
        assert (V.products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()
        assert rest.max() < 0.03


def test_large_doubles_do_not_overflow(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [1e300, -1e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, V.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
