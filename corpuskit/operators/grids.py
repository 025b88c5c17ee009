"""The grid of a table from the places of its words: rows by running mean, columns by a sweep over edges.

``grid`` is for one table. ``grids`` takes many in step: the n-th word of all of them, then the n-th cell.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpuskit.operators.sheets import firsts, places


def level_groups(values: list[float], tolerance: float) -> list[int]:
    """A group number for each of the sorted values: one that is near the mean of the open group is in it."""
    out, group, total, n = [], -1, 0.0, 0
    for v in values:
        if n and abs(v - total / n) <= tolerance:
            total, n = total + v, n + 1
        else:
            group, total, n = group + 1, v, 1
        out.append(group)
    return out


def joined_words(words: list[tuple[float, float, str]], gap: float) -> list[tuple[float, float, str]]:
    """Cells (left, right, text) of a row of words: a word within ``gap`` of what is before it belongs to that."""
    cells: list[tuple[float, float, str]] = []
    for left, right, text in sorted(words):
        if cells and left - cells[-1][1] <= gap:
            x, r, t = cells[-1]
            cells[-1] = (x, max(r, right), f"{t} {text}")
        else:
            cells.append((left, right, text))
    return cells


def spanning(cells: list[tuple[float, float, int]]) -> set[int]:
    """The cells (left, right, row) that lie over two or more cells of the fullest row."""
    by_row: dict[int, list[tuple[float, float]]] = {}
    for left, right, row in cells:
        by_row.setdefault(row, []).append((left, right))
    fullest = min(by_row, key=lambda r: (-len(by_row[r]), r))
    lefts, rights = zip(*sorted(by_row[fullest]), strict=True)
    # cells of a row are apart, so both edges are sorted
    return {
        k for k, (left, right, row) in enumerate(cells)
        if row != fullest and bisect_right(lefts, right - 1e-9) - bisect_right(rights, left + 1e-9) > 1
    }


class _Column:
    """Cells of different rows whose edges line up."""

    def __init__(self) -> None:
        self.cells: list[int] = []
        self.rows: set[int] = set()
        self.left = self.right = 0.0
        self.lo, self.hi = float("inf"), float("-inf")

    def add(self, k: int, left: float, right: float, row: int) -> None:
        n = len(self.cells)
        self.left, self.right = (self.left * n + left) / (n + 1), (self.right * n + right) / (n + 1)
        self.lo, self.hi = min(self.lo, left), max(self.hi, right)
        self.cells.append(k)
        self.rows.add(row)

    def off(self, left: float, right: float) -> float:
        """How far the nearer edge is from this column's."""
        return min(abs(left - self.left), abs(right - self.right))


def columns(cells: list[tuple[float, float, int]], reach: float) -> tuple[list[int], int]:
    """(column of each cell (left, right, row), number of columns).

    Cells are met from left to right. Each goes to the column with the nearest left or right edge, among
    those that have nothing in its row and that it lies over or lines up with; otherwise it opens one.
    Neighbours without a common row and without space between them are one column. Cells that span
    columns open none: they go to the nearest one that is free in their row.
    """
    wide = spanning(cells)
    found: list[_Column] = []
    for k in sorted(range(len(cells)), key=lambda k: (*cells[k], k)):
        if k in wide:
            continue
        left, right, row = cells[k]
        fits = [
            c for c in found
            if row not in c.rows and ((left < c.hi and c.lo < right) or c.off(left, right) <= reach)
        ]
        if fits:
            best = min(fits, key=lambda c: c.off(left, right))
        else:
            best = _Column()
            found.append(best)
        best.add(k, left, right, row)
    found.sort(key=lambda c: (c.left, c.right))
    merged: list[_Column] = []
    for c in found:
        if merged and c.left - merged[-1].right <= 5 and not c.rows & merged[-1].rows:
            for k in c.cells:
                merged[-1].add(k, *cells[k])
        else:
            merged.append(c)
    place = [0] * len(cells)
    for n, c in enumerate(merged):
        for k in c.cells:
            place[k] = n
    for k in sorted(wide):
        left, right, row = cells[k]
        free = [n for n, c in enumerate(merged) if row not in c.rows] or list(range(len(merged)))
        place[k] = min(free, key=lambda n: (merged[n].off(left, right), n))
        merged[place[k]].rows.add(row)
    return place, len(merged)


def grid(words: list[tuple[float, float, float, str, float]]) -> list[list[str]]:
    """Rows of equally many values from words (y, left, right, text, height)."""
    tall = sorted(w[4] for w in words if w[4] > 0)
    usual = tall[len(tall) // 2] if tall else 10.0
    words = sorted(words)
    rows: dict[int, list[tuple[float, float, str]]] = {}
    for r, (_, left, right, text, _) in zip(level_groups([w[0] for w in words], max(3.0, usual * 0.5)), words, strict=True):
        rows.setdefault(r, []).append((left, right, text))
    cells = [(left, right, r, text) for r, row in rows.items() for left, right, text in joined_words(row, max(8.0, usual * 0.6))]
    place, n = columns([c[:3] for c in cells], max(20.0, usual * 2))
    out = [[""] * n for _ in rows]
    for (_, _, r, text), c in sorted(zip(cells, place, strict=True)):
        out[r][c] = f"{out[r][c]} {text}" if out[r][c] else text
    return out


MOST_WORDS = 512
MOST_ROWS = 64  # a column's rows are the bits of one number


def _bounds(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the groups 0 to n - 1 begins in the sorted ``group``, and its size."""
    at = np.searchsorted(group, np.arange(n + 1))
    return at[:-1], np.diff(at)


def _in_step(at: np.ndarray, size: np.ndarray):
    """For n = 0, 1, ...: the groups of more than n members, and the place of the n-th of each."""
    order = np.argsort(-size, kind="stable")
    left = -size[order]
    for n in range(-int(left[0]) if len(left) else 0):
        some = order[:np.searchsorted(left, -n)]
        yield some, at[some] + n


def _usual(table: np.ndarray, tall: np.ndarray, n: int) -> np.ndarray:
    """Upper median of the heights above 0 of each table, or 10."""
    some = np.flatnonzero(tall > 0)
    some = some[np.lexsort((tall[some], table[some]))]
    at, size = _bounds(table[some], n)
    out = np.full(n, 10.0)
    out[size > 0] = tall[some[(at + size // 2)[size > 0]]]
    return out


def _levels(y: np.ndarray, at: np.ndarray, size: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """``level_groups`` of each table's sorted ``y``."""
    total, n, group = np.zeros(len(at)), np.zeros(len(at)), np.full(len(at), -1)
    out = np.zeros(len(y), "int64")
    for some, k in _in_step(at, size):
        v = y[k]
        near = (n[some] > 0) & (np.abs(v - total[some] / np.maximum(n[some], 1)) <= tolerance[some])
        total[some], n[some] = np.where(near, total[some] + v, v), np.where(near, n[some] + 1, 1)
        group[some] += ~near
        out[k] = group[some]
    return out


def _running_max(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Greatest value so far in each run of equal ``group``s, which ascend."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), "int64")
    rank[order] = np.arange(len(values))
    base = group * len(values)
    return values[order[np.maximum.accumulate(base + rank) - base]]


def _any_wide(table: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which tables have cells that ``spanning`` gives. Cells are by table, row and place."""
    line = np.cumsum(np.diff(table * MOST_ROWS + row, prepend=-1) != 0) - 1
    at = firsts(line)
    size = np.diff(np.append(at, len(line)))
    order = np.lexsort((row[at], -size, table[at]))
    order = order[firsts(table[at][order])]
    best = np.zeros(n, "int64")
    best[table[at[order]]] = order
    rest = np.flatnonzero(line != best[table])
    much = size[best[table[rest]]]
    cell = np.repeat(rest, much)
    other = np.repeat(at[best[table[rest]]], much) + np.arange(much.sum()) - np.repeat(np.cumsum(much) - much, much)
    over = (left[other] <= right[cell] - 1e-9).astype("int64") - (right[other] <= left[cell] + 1e-9)
    out = np.zeros(n, bool)
    out[table[np.flatnonzero(np.bincount(cell, over, len(table)) > 1)]] = True
    return out


def _swept(table: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``columns`` of tables without wide cells: column of each cell, columns of each table, and where columns must merge."""
    n = len(reach)
    order = np.lexsort((row, right, left, table))
    wide, count = 4, np.zeros(n, "int64")
    bit = np.uint64(1) << row.astype("uint64")
    m, lefts, rights, lo, hi = (np.full((n, wide), v) for v in (0.0, 0.0, 0.0, np.inf, -np.inf))
    rows = np.zeros((n, wide), "uint64")
    place = np.zeros(len(table), "int64")
    for some, k in _in_step(*_bounds(table, n)):
        if count.max() == wide:
            m, lefts, rights, lo, hi, rows = (
                np.concatenate((a, np.full((n, wide), v, a.dtype)), axis=1)
                for a, v in ((m, 0), (lefts, 0), (rights, 0), (lo, np.inf), (hi, -np.inf), (rows, 0))
            )
            wide *= 2
        c = order[k]
        x, r = left[c], right[c]
        off = np.minimum(np.abs(x[:, None] - lefts[some]), np.abs(r[:, None] - rights[some]))
        fits = (m[some] > 0) & (rows[some] & bit[c][:, None] == 0) & (
            (x[:, None] < hi[some]) & (lo[some] < r[:, None]) | (off <= reach[some][:, None])
        )
        best = np.where(fits.any(axis=1), np.where(fits, off, np.inf).argmin(axis=1), count[some])
        had = m[some, best]
        lefts[some, best], rights[some, best] = (lefts[some, best] * had + x) / (had + 1), (rights[some, best] * had + r) / (had + 1)
        lo[some, best], hi[some, best] = np.minimum(lo[some, best], x), np.maximum(hi[some, best], r)
        m[some, best], rows[some, best] = had + 1, rows[some, best] | bit[c]
        count[some] = np.maximum(count[some], best + 1)
        place[c] = best
    of, nth = np.nonzero(m)
    across = np.lexsort((nth, rights[of, nth], lefts[of, nth], of))
    of, nth = of[across], nth[across]
    where = np.zeros((n, wide), "int64")
    where[of, nth] = places(of) if len(of) else of
    near = (of[1:] == of[:-1]) & (lefts[of, nth][1:] - rights[of, nth][:-1] <= 5) & (rows[of, nth][1:] & rows[of, nth][:-1] == 0)
    merge = np.zeros(n, bool)
    merge[of[1:][near]] = True
    return where[table, place], count, merge


def grids(table: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, text: pa.Array, tall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Table, row, column and value of the ``grid`` of each of many tables, from their words by ascending ``table``.

    Tables with cells that span columns, columns that merge, words in the very same place, or very many words are
    left to ``grid`` one by one; all others give the same without a step of Python for each word.
    """
    n = int(table[-1]) + 1
    usual = _usual(table, tall, n)
    plain = np.zeros(n, bool)
    plain[table[~(np.isfinite(y) & np.isfinite(left) & np.isfinite(right) & np.isfinite(tall)) | (right < left)]] = True
    plain |= np.bincount(table, minlength=n) > MOST_WORDS

    def rest(*cols):
        keep = np.flatnonzero(~plain[cols[0]])
        return [c.take(pa.array(keep)) if isinstance(c, pa.Array) else c[keep] for c in cols]

    t, v, x, r, s = rest(table, y, left, right, text)
    down = np.lexsort((v, t))
    row = np.zeros(len(t), "int64")
    row[down] = _levels(v[down], *_bounds(t, n), np.maximum(3.0, usual * 0.5))
    plain[t[row >= MOST_ROWS]] = True
    t, row, x, r, s = rest(t, row, x, r, s)
    across = np.lexsort((r, x, row, t))
    t, row, x, r, s = t[across], row[across], x[across], r[across], s.take(pa.array(across))
    line = np.cumsum(np.diff(t * MOST_ROWS + row, prepend=-1) != 0)
    twice = (line[1:] == line[:-1]) & (x[1:] == x[:-1]) & (r[1:] == r[:-1])
    plain[t[1:][twice]] = True
    t, row, x, r, s, line = rest(t, row, x, r, s, line)
    if len(t):
        far = x[1:] - _running_max(line, r)[:-1] > np.maximum(8.0, usual * 0.6)[t[1:]]
        at = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | far)))
        s = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(t)), pa.int32()), s), " ")
        t, row, x, r = t[at], row[at], x[at], np.maximum.reduceat(r, at)
        plain |= _any_wide(t, row, x, r, n)
    t, row, x, r, s = rest(t, row, x, r, s)
    col, wide, merge = _swept(t, row, x, r, np.maximum(20.0, usual * 2))
    plain |= merge
    t, row, col, s = rest(t, row, col, s)
    tall_of = np.zeros(n, "int64")
    np.maximum.at(tall_of, t, row + 1)
    size = tall_of * wide * ~plain
    at = np.cumsum(size) - size
    of = np.repeat(np.arange(n), size)
    nth = np.arange(len(of)) - at[of]
    take = np.full(len(of), len(t))
    take[at[t] + row * wide[t] + col] = np.arange(len(t))
    value = pa.concat_arrays([s.cast(pa.string()), pa.array([""])]).take(pa.array(take))
    out = [(of, nth // wide[of], nth % wide[of], value)]
    begin, size = _bounds(table, n)
    for k in np.flatnonzero(plain & (size > 0)).tolist():
        a, b = begin[k], begin[k] + size[k]
        cells = grid(list(zip(y[a:b].tolist(), left[a:b].tolist(), right[a:b].tolist(), text.slice(a, b - a).to_pylist(), tall[a:b].tolist(), strict=True)))
        across = np.arange(len(cells) * len(cells[0]))
        out.append((np.full(len(across), k), across // len(cells[0]), across % len(cells[0]), pa.array([v for c in cells for v in c], pa.string())))
    return (*[np.concatenate(c) for c in list(zip(*out, strict=True))[:3]], pa.concat_arrays([o[3] for o in out]))
