"""Anchored diffs of long texts: minimal, whole, and in bounded parts."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import compare as C
from corpuskit.operators import long_diff as L


def edited(rng, words, n, vocab):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out) + 1) if out else 0
        act = rng.random()
        if act < 0.35 and out:
            out[min(at, len(out) - 1)] = rng.choice(vocab)
        elif act < 0.6:
            out.insert(at, rng.choice(vocab))
        elif act < 0.9 and out:
            del out[min(at, len(out) - 1)]
        else:
            to = min(len(out), at + rng.randint(1, 60))
            moved = out[at:to]
            del out[at:to]
            back = rng.randrange(len(out) + 1)
            out[back:back] = moved
    return out


def least_edits(old, new):
    number = {w: i for i, w in enumerate({*old, *new})}
    return len(old) + len(new) - 2 * len(C._common([number[w] for w in old], [number[w] for w in new]))


def scripts(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.pair_id, r.part, r.piece)):
        out.setdefault(r.pair_id, []).extend((c.op, c.text) for c in r.chunks)
    return out


def test_whole_and_minimal(spark, monkeypatch):
    monkeypatch.setattr(L, "CELL", 16)
    rng = random.Random(11)
    pairs = [(0, "", ""), (1, None, "a b"), (2, "a b", None), (3, "x " * 400, "x " * 380), (4, "a b c " * 40, "c b a " * 40)]
    for i in range(5, 60):
        vocab = [f"w{k}" for k in range(rng.choice([8, 60, 2000]))]
        old = [rng.choice(vocab) for _ in range(rng.randint(0, 900))]
        pairs.append((i, " ".join(old), " ".join(edited(rng, old, rng.choice([0, 1, 4, 15, 60]), vocab))))
    got = scripts(L.diff_long(spark.createDataFrame(pairs, "pair_id long, old string, new string")).collect())
    for i, a, b in pairs:
        old, new = (a or "").split(), (b or "").split()
        script = got.get(i, [])
        assert [w for op, w in script if op != "insert"] == old
        assert [w for op, w in script if op != "delete"] == new
        assert sum(op != "equal" for op, _ in script) == least_edits(old, new), i


def test_certain_blocks_of_moved_text():
    # a block that a cheaper script leaves out is no cut
    chain = L.chained([(0, 900, 50), (60, 0, 800)])
    assert chain == [(60, 0, 800)]
    assert L.certain([(0, 900, 50)], 860, 950) == []
    # the second block is only certain once the first has cut the bound of eight edits to six
    assert L.certain([(1, 1, 100), (103, 103, 40)], 144, 144) == [(1, 1, 100), (103, 103, 40)]
    assert L.certain([(1, 1, 100), (103, 103, 34)], 138, 138) == [(1, 1, 100)]


def test_two_million_words_in_bounded_parts(spark):
    n = 2_000_000
    rng = random.Random(5)
    old = [f"w{rng.randrange(50_000)}" for _ in range(n)]
    new = list(old)
    places = sorted(rng.sample(range(n), 600), reverse=True)
    for k, at in enumerate(places):
        if k % 3 == 0:
            new[at] = f"changed{at}"
        elif k % 3 == 1:
            new.insert(at, f"added{at}")
        else:
            del new[at]
    df = spark.createDataFrame([(1, " ".join(old), " ".join(new))], "pair_id long, old string, new string")

    def count(op):
        return F.size(F.filter("chunks", lambda c: c["op"] == op)).alias(op)

    out = L.diff_long(df).select("part", "piece", F.size("chunks").alias("n"), *map(count, ("equal", "insert", "delete"))).cache()
    total = out.agg(*[F.sum(c) for c in ("equal", "insert", "delete")]).first()
    assert tuple(total) == (n - 400, 400, 400)
    assert out.agg(F.max("n")).first()[0] <= L.CELL
    out.unpersist()


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(1, "a b c", "a c")][:n], "pair_id long, old string, new string")
    assert scripts(L.diff_long(df).collect()) == ({1: [("equal", "a"), ("delete", "b"), ("equal", "c")]} if n else {})


def test_pairs_of_few_cells_are_not_shuffled(spark):
    d = L._solved(spark.createDataFrame([(1, "a b c", "a x c")], "pair_id long, old string, new string"), "pair_id")
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    rows = [(i, "a b " * 3000, "a " * 3000) for i in range(4)]
    got = L.diff_long(spark.createDataFrame(rows, "pair_id long, old string, new string")).collect()
    assert [(r.part, r.piece) for r in got] == [(0, 0)] * 4 and all(sum(c.op == "delete" for c in r.chunks) == 3000 for r in got)
