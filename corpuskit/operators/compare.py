"""Comparing versions of texts: word diff, its summary, page-wise comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpuskit.functions.text import chars, collapse_space
from corpuskit.operators import sheets as SH
from corpuskit.operators.ordered import keep_parallel

CHUNKS = "array<struct<op:string,text:string>>"


def words(text: Column) -> Column:
    flat = collapse_space(F.coalesce(text, F.lit("")))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " ", -1))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading members two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_bad = F.array_position(same, F.lit(False))
    return F.when(first_bad > 0, first_bad - 1).otherwise(F.size(same).cast("bigint"))


def trimmed(pairs: DataFrame) -> DataFrame:
    """Pairs as word arrays with shared head and tail split off: head, mid_old, mid_new, tail."""
    w = pairs.withColumns({"_o": words(F.col("old")), "_n": words(F.col("new"))})
    w = w.withColumn("_p", common_prefix(F.col("_o"), F.col("_n")).cast("int"))
    w = w.withColumns({
        "_ro": F.slice("_o", F.col("_p") + 1, F.size("_o")), "_rn": F.slice("_n", F.col("_p") + 1, F.size("_n")),
    })
    w = w.withColumn("_s", common_prefix(F.reverse("_ro"), F.reverse("_rn")).cast("int"))
    return w.withColumns({
        "head": F.slice("_o", F.lit(1), F.col("_p")),
        "mid_old": F.slice("_ro", F.lit(1), F.size("_ro") - F.col("_s")),
        "mid_new": F.slice("_rn", F.lit(1), F.size("_rn") - F.col("_s")),
        "tail": F.slice("_o", F.size("_o") - F.col("_s") + 1, F.col("_s")),
    })


def _flags(vector: int, n: int) -> np.ndarray:
    raw = vector.to_bytes((n + 7) // 8, "little")
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n).astype(bool)


class _Rows:
    """Longest common subsequences of the prefixes of ``a`` with all prefixes of ``b`` at once.

    A row is one whole number whose bit j is 0 if the length grows with word j of ``b``. A word
    of ``a`` changes the row with an addition and a few logic operations, so thousands of words of
    ``b`` are dealt with in one machine operation each 64.
    """

    def __init__(self, b: list[int]):
        self.n = len(b)
        self.full = (1 << self.n) - 1
        self.where: dict[int, list[int]] = {}
        for j, w in enumerate(b):
            self.where.setdefault(w, []).append(j)
        self.masks: dict[int, int] = {}
        self.room = 1 << 29  # bits of masks kept

    def mask(self, word: int) -> int:
        known = self.masks.get(word)
        if known is None:
            at = self.where.get(word, ())
            if len(at) > 8:
                bits = np.zeros(self.n, np.uint8)
                bits[at] = 1
                known = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                known = sum(1 << j for j in at)
            if self.room > 0:
                self.room -= self.n
                self.masks[word] = known
        return known

    def after(self, row: int, word: int) -> int:
        hit = row & self.mask(word)
        return ((row + hit) | (row - hit)) & self.full

    def lengths(self, a: list[int]) -> np.ndarray:
        """Length of the longest common subsequence of ``a`` with each prefix of ``b``."""
        row = self.full
        for w in a:
            row = self.after(row, w)
        return np.concatenate([[0], np.cumsum(~_flags(row, self.n))])


TABLE_BITS = 1 << 25


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order.

    Pairs too large to keep all rows are cut in two where the lengths of both halves add up to
    the most, which loses nothing; so memory stays linear and no length is refused.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 > 1 and (a1 - a0) * (b1 - b0) > TABLE_BITS:
            cut = (a0 + a1) // 2
            fore = _Rows(b[b0:b1]).lengths(a[a0:cut])
            back = _Rows(b[b0:b1][::-1]).lengths(a[cut:a1][::-1])[::-1]
            split = b0 + int(np.argmax(fore + back))
            todo += [(a0, cut, b0, split), (cut, a1, split, b1)]
            continue
        rows = _Rows(b[b0:b1])
        table = [rows.full]
        for w in a[a0:a1]:
            table.append(rows.after(table[-1], w))
        i, j = a1 - a0, b1 - b0
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif table[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                found.append((a0 + i, b0 + j))
            else:
                i -= 1
    return sorted(found)


def contained(a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
    """Places (i, j) that match all of the shorter side, if it stands in the other in order.

    Then nothing can be longer. Taking the earliest place for each word finds such a match.
    """
    flip = len(a) > len(b)
    short, long = (b, a) if flip else (a, b)
    found, j = [], 0
    for i, w in enumerate(short):
        try:
            j = long.index(w, j) + 1
        except ValueError:
            return None
        found.append((j - 1, i) if flip else (i, j - 1))
    return found


def middle(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """(op, word) of the differing middle, inserts before deletes inside one change.

    Words that only one side has cannot be equal to anything, so only the others are matched.
    """
    shared = {w: n for n, w in enumerate(set(old) & set(new))}
    left = [i for i, w in enumerate(old) if w in shared]
    right = [j for j, w in enumerate(new) if w in shared]
    common = contained([shared[old[i]] for i in left], [shared[new[j]] for j in right]) or _common([shared[old[i]] for i in left], [shared[new[j]] for j in right])
    out: list[tuple[str, str]] = []
    i = j = 0
    for x, y in [*((left[x], right[y]) for x, y in common), (len(old), len(new))]:
        out += [("insert", w) for w in new[j:y]] + [("delete", w) for w in old[i:x]]
        if x < len(old):
            out.append(("equal", old[x]))
        i, j = x + 1, y + 1
    return out


def _chunks(op: str, arr: Column) -> Column:
    return F.transform(arr, lambda w: F.struct(F.lit(op).alias("op"), w.alias("text")))


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """Word diff per pair (pair_id, old, new) as an array of (op, text).

    Shared head and tail are cut off in the JVM; only the differing middle needs a script. Rows
    are spread evenly before the kernel, as a long middle costs far more than a short one.
    The script is minimal at any length.
    """
    t = trimmed(pairs)
    # words hold no blanks, so word lists travel to Python and back as plain strings; there is no
    # filter on them, since a pushed-down filter would compute all of the trimming once more
    flat = [F.array_join(c, " ").alias(c) for c in ("head", "mid_old", "mid_new", "tail")]
    rows = keep_parallel(t.select("pair_id", *flat), "pair_id")

    def listed_words(text: str) -> list[str]:
        return text.split(" ") if text else []

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ops, texts = [], []
            for a, b in zip(pdf["mid_old"], pdf["mid_new"], strict=True):
                mid = middle(listed_words(a), listed_words(b))
                ops.append("".join(op[0] for op, _ in mid))
                texts.append(" ".join(w for _, w in mid))
            yield pdf[["pair_id", "head", "tail"]].assign(ops=ops, mid=texts)

    kind = dict(rows.dtypes)["pair_id"]
    solved = rows.mapInPandas(kernel, f"pair_id {kind}, head string, tail string, ops string, mid string")
    names = F.create_map(*[F.lit(x) for op in ("equal", "insert", "delete") for x in (op[0], op)])
    def listed(c: str) -> Column:
        return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " ", -1))

    mid = F.zip_with(
        chars(F.col("ops")), listed("mid"),
        lambda o, w: F.struct(F.element_at(names, o).alias("op"), w.alias("text")),
    )
    out = F.concat(_chunks("equal", listed("head")), mid, _chunks("equal", listed("tail"))).cast(CHUNKS)
    return solved.select("pair_id", out.alias("chunks"))


def coarse_diff(pairs: DataFrame) -> DataFrame:
    """One run of inserts and one of deletes between shared head and tail."""
    coarse = F.concat(_chunks("insert", F.col("mid_new")), _chunks("delete", F.col("mid_old")))
    whole = F.concat(_chunks("equal", F.col("head")), coarse, _chunks("equal", F.col("tail")))
    return trimmed(pairs).select("pair_id", whole.cast(CHUNKS).alias("chunks"))


def _summaries(old: pa.Array, new: pa.Array) -> list[np.ndarray]:
    """The counts of ``diff_summary`` for some pairs of texts. Words are compared as whole numbers."""
    n = len(old)
    (po, wo), (pn, wn) = SH.words_of(old), SH.words_of(new)
    codes = SH.numbers(pa.concat_arrays([wo["str"], wn["str"]]).dictionary_encode().indices).astype("int64")
    co, cn = codes[:len(po)], codes[len(po):]
    ends_o, ends_n = np.searchsorted(po, np.arange(n), "right"), np.searchsorted(pn, np.arange(n), "right")
    len_o, len_n = np.bincount(po, minlength=n), np.bincount(pn, minlength=n)
    at_o, at_n = ends_o - len_o, ends_n - len_n

    def shared(most, place_o, place_n):
        """How many of the first ``most`` words, seen from either end, are equal."""
        pair = np.repeat(np.arange(n), most)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
        bad = np.flatnonzero(co[place_o(pair, k)] != cn[place_n(pair, k)])
        some, first = np.unique(pair[bad], return_index=True)
        out = most.copy()
        out[some] = k[bad[first]]
        return out

    least = np.minimum(len_o, len_n)
    head = shared(least, lambda p, k: at_o[p] + k, lambda p, k: at_n[p] + k)
    tail = shared(least - head, lambda p, k: ends_o[p] - 1 - k, lambda p, k: ends_n[p] - 1 - k)

    def middle_of(page, code, at, ends):
        place = np.arange(len(page))
        keep = (place >= (at + head)[page]) & (place < (ends - tail)[page])
        return page[keep] * (len(codes) + 1) + code[keep]

    left, right = middle_of(po, co, at_o, ends_o), middle_of(pn, cn, at_n, ends_n)
    some, which = np.unique(np.concatenate((left, right)), return_inverse=True)
    more = np.bincount(which, np.repeat([1, -1], [len(left), len(right)]), len(some))
    pair = some // (len(codes) + 1)
    only = [np.bincount(pair, np.maximum(d, 0), n).astype("int64") for d in (more, -more)]
    return [len_o, len_n, head, tail, *only]


def diff_summary(pairs: DataFrame) -> DataFrame:
    """Word counts per pair: both sides, shared head and tail, words only on either side.

    A pair is one row, so nothing is shuffled; the words of many pairs are counted at once.
    """
    rows = pairs.select("pair_id", "old", "new")
    counts = ("words_old", "words_new", "equal_prefix", "equal_suffix", "only_old", "only_new")
    out = StructType([rows.schema["pair_id"], *[StructField(c, LongType()) for c in counts]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy().astype("int64") for i in (1, 2))
            cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // SH.TEXT_AT_ONCE)) + 1).tolist(), len(size)]
            for lo, hi in zip(cuts, cuts[1:]):
                some = batch.slice(lo, hi - lo)
                if hi > lo:
                    yield pa.RecordBatch.from_arrays([some.column(0), *map(pa.array, _summaries(some.column(1), some.column(2)))], names=out.names)

    return rows.mapInArrow(kernel, out)


def compare_documents(a: DataFrame, b: DataFrame, unchanged: str = "mark") -> DataFrame:
    """Page-wise comparison of two versions (doc_id, page_no, text); a one-sided page is changed.

    Only hashes travel through the shuffle. ``unchanged='skip'`` leaves equal pages out.
    """
    def side(d, name):
        return d.select("doc_id", "page_no", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))

    j = side(a, "_ha").join(side(b, "_hb"), ["doc_id", "page_no"], "full")
    out = j.select(
        "doc_id", "page_no", (~F.col("_ha").eqNullSafe(F.col("_hb"))).alias("changed"),
        F.col("_ha").isNotNull().alias("in_a"), F.col("_hb").isNotNull().alias("in_b"),
    )
    return out.filter("changed") if unchanged == "skip" else out
