"""Grids against plain clustering of every pair of cells."""

import random

import numpy as np
import pyarrow as pa

from corpuskit.operators import grids as G


def words_of(rows, left, width, height=10.0, slope=0.0, right_aligned=()):
    out = []
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            if not text:
                continue
            w = 5.0 * len(text)
            x = left[c] + width[c] - w if c in right_aligned else left[c]
            y = r * 2 * height + slope * c
            for part in text.split():
                out.append((y, x, x + 5.0 * len(part), part, height))
                x += 5.0 * (len(part) + 1)
    return out


def test_running_mean_of_rows():
    assert G.level_groups([0, 4, 8], 5) == [0, 0, 1]
    assert G.level_groups([0, 3, 4.5, 6.5], 5) == [0, 0, 0, 0]
    assert G.level_groups([], 5) == []


def test_right_edges_line_up():
    words = [(0, 20, 50, "Item", 10), (0, 100, 118, "Qty", 10), (20, 20, 60, "Bolt", 10), (20, 125, 135, "7", 10)]
    assert G.grid([(float(y), float(a), float(b), t, float(h)) for y, a, b, t, h in words]) == [["Item", "Qty"], ["Bolt", "7"]]


def test_two_cells_of_a_row_are_never_one_column():
    words = [(0.0, 0.0, 10.0, "a", 10.0), (0.0, 19.0, 29.0, "b", 10.0), (20.0, 12.0, 22.0, "c", 10.0)]
    got = G.grid(words)
    assert got[0] == ["a", "b"] and sorted(got[1]) == ["", "c"]


def test_wide_cells_do_not_make_columns():
    rows = [["Date", "Text", "Amount"], ["01/02", "Coffee", "4.50"], ["02/02", "", "12.00"]]
    words = words_of(rows, [0, 100, 200], [60, 60, 60])
    words.append((60.0, 0.0, 260.0, "Carried over to the next page", 10.0))
    assert G.grid(words) == [*rows, ["Carried over to the next page", "", ""]]


def test_random_tables_come_back():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(2, 7)
        width = [rng.randint(40, 110) for _ in range(n)]
        left = [sum(width[:c]) + 45 * c for c in range(n)]
        right = {c for c in range(n) if rng.random() < 0.4}
        full = [[" ".join("x" * rng.randint(1, 4) for _ in range(rng.randint(1, 2))) for _ in range(n)] for _ in range(rng.randint(2, 9))]
        rows = [full[0], *[[v if rng.random() < 0.8 else "" for v in row] for row in full[1:]]]
        rows = [r for r in rows if any(r)]
        words = words_of(rows, left, width, slope=rng.choice([0, 0.7, -0.7]), right_aligned=right)
        rng.shuffle(words)
        assert G.grid(words) == rows, (rows, right)


def test_many_tables_in_step_are_the_tables_one_by_one(monkeypatch):
    rng = random.Random(8)
    tables = []
    for n in range(400):
        words = []
        for r in range(rng.randint(1, 6)):
            for c in range(rng.randint(1, 5)):
                if rng.random() < 0.85:
                    x = c * rng.choice([60, 75, 75, 75]) + rng.choice([0, 0, 0, 7, 20])
                    w = rng.choice([5, 12, 12, 30, 30, 30, 150 if n % 7 == 0 else 40])
                    words.append((r * rng.choice([6.0, 20.0, 20.0]) + rng.choice([0, 1, 2.5]), float(x), float(x + w), rng.choice("abc"), rng.choice([0.0, 8.0, 10.0, 14.0])))
        tables += [words] if words else []
    want = [(k, r, c, v) for k, t in enumerate(tables) for r, row in enumerate(G.grid(t)) for c, v in enumerate(row)]
    single = []
    one = G.grid
    monkeypatch.setattr(G, "grid", lambda words: single.append(1) or one(words))
    flat = [w for t in tables for w in t]
    y, left, right, text, tall = zip(*flat)
    at = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    got = G.grids(at, np.array(y), np.array(left), np.array(right), pa.array(text), np.array(tall))
    assert sorted(zip(*[g.tolist() for g in got[:3]], got[3].to_pylist())) == sorted(want)
    # most went in step, some did not
    assert 0 < len(single) < len(tables) * 0.7
    clean = [w for t in tables[:20] for w in [(20.0 * r, 100.0 * c, 100.0 * c + 30, "x", 10.0) for r in range(3) for c in range(4)]]
    single.clear()
    y, left, right, text, tall = zip(*clean)
    got = G.grids(np.repeat(np.arange(20), 12), np.array(y), np.array(left), np.array(right), pa.array(text), np.array(tall))
    assert len(got[0]) == 240 and not single
