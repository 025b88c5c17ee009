"""Minimal word diff of texts of any length, cut into bounded parts at places that no minimal script avoids.

Both sides are cells of ``CELL`` words. Runs of ``GRAM`` words that occur once on either side are anchors,
found by grouping their hashes; neighbouring anchors on one diagonal are a block. A small kernel per pair
sees only the blocks. It chains them (heaviest increasing chain), which bounds the number of edits, and
keeps as cuts only blocks that are certain:

A block of L words holds L // GRAM disjoint anchors. A script that matches none of them as a whole has an
edit in each, so if a segment is known to need fewer edits, a minimal script matches one, which can only be
at its own place, and from there, word by word, the whole block. Such a block splits the segment in two;
each half has its own, smaller bound, which makes more blocks certain, and so on.

Pairs of up to ``WHOLE`` cells on either side are solved where they stand, without a shuffle.
Between two cuts the rest is a row of its own, with a minimal script of its own. Without certain blocks (all is
different, or moved) the whole pair stays one row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import collapse_space
from corpuskit.operators.compare import CHUNKS, _chunks, middle, words
from corpuskit.operators.ordered import keep_parallel

CELL = 1024
WHOLE = 8
GRAM = 5


def _cells(pairs: DataFrame) -> DataFrame:
    """(pair_id, side, cell, words): side 0 is old; a cell also has the first words of the next one."""
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), words(F.col("old")).alias("w")),
        F.struct(F.lit(1).alias("side"), words(F.col("new")).alias("w")),
    )).alias("s")).select("pair_id", "s.side", "s.w")
    cells = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("w") - 1) / CELL).cast("int")),
        lambda c: F.struct(c.alias("cell"), F.slice("w", c * CELL + 1, F.lit(CELL + GRAM - 1)).alias("words")),
    )
    return sides.filter(F.size("w") > 0).select("pair_id", "side", F.size("w").alias("n_words"), F.inline(cells))


def _blocks(cells: DataFrame) -> DataFrame:
    """(pair_id, i, j, m): m anchors from old place i and new place j on, within one cell."""
    grams = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(CELL), F.size("words") - (GRAM - 1))),
        lambda i: F.struct(
            (F.col("cell") * CELL + i - 1).alias("pos"), F.xxhash64(F.array_join(F.slice("words", i, F.lit(GRAM)), " ")).alias("h"),
        ),
    )
    all_grams = cells.filter(F.size("words") >= GRAM).select("pair_id", "side", F.inline(grams))
    old = F.col("side") == 0
    anchors = all_grams.groupBy("pair_id", "h").agg(
        F.sum(F.when(old, 1).otherwise(0)).alias("n_old"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(old, F.col("pos"))).alias("i"), F.max(F.when(~old, F.col("pos"))).alias("j"),
    ).filter("n_old = 1 AND n = 2")
    # a block ends at its cell here; the kernel joins what continues
    in_cell = [F.col("pair_id"), F.floor(F.col("i") / CELL)]
    order = Window.partitionBy(*in_cell).orderBy(F.col("j") - F.col("i"), "i")
    fresh = (F.col("j") - F.col("i") != F.lag(F.col("j") - F.col("i")).over(order)) | (F.col("i") - F.lag("i").over(order) != 1)
    flagged = anchors.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    island = flagged.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = island.groupBy(*in_cell, "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count(F.lit(1)).alias("m"))
    # shorter ones are never certain on their own; leaving them out keeps the list below a fifth of the words
    return blocks.filter(F.col("m") >= GRAM).select("pair_id", "i", "j", "m")


def chained(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The heaviest chain of blocks (i, j, words), increasing on both sides, overlaps cut off."""
    blocks = sorted(blocks)
    keys: list[int] = []       # new places, with the best weight of a chain that ends there or before: both increase
    best: list[tuple[int, int]] = []
    before: list[int] = []
    for t, (_, j, n) in enumerate(blocks):
        at = bisect_left(keys, j)
        weight, last = best[at - 1] if at else (0, -1)
        before.append(last)
        weight += n
        while at < len(keys) and best[at][0] <= weight:
            del keys[at], best[at]
        if not at or best[at - 1][0] < weight:
            keys.insert(at, j)
            best.insert(at, (weight, t))
    chain = []
    t = best[-1][1] if best else -1
    while t >= 0:
        chain.append(blocks[t])
        t = before[t]
    out: list[tuple[int, int, int]] = []
    for i, j, n in reversed(chain):
        if out:
            over = max(0, out[-1][0] + out[-1][2] - i, out[-1][1] + out[-1][2] - j)
            i, j, n = i + over, j + over, n - over
        if n > 0:
            out.append((i, j, n))
    return out


def certain(chain: list[tuple[int, int, int]], n_old: int, n_new: int, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """The blocks of a chain that a minimal script of ``n_old`` and ``n_new`` words has in it."""
    ends = [(0, 0, 0), *chain, (n_old, n_new, 0)]
    edits = [0]
    for (i, j, n), (x, y, _) in zip(ends, ends[1:]):
        edits.append(edits[-1] + (x - i - n) + (y - j - n))
    kept = []
    todo = [(0, len(ends) - 1)]
    while todo:
        a, b = todo.pop()
        bound = edits[b] - edits[a]
        sure = [t for t in range(a + 1, b) if ends[t][2] // gram > bound]
        if sure:
            kept += sure
            todo += list(zip([a, *sure], [*sure, b]))
    return [ends[t] for t in sorted(kept)]


def _joined(rows: list[tuple[int, int, int]], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Blocks of anchors as blocks of words; those that continue over the edge of a cell become one."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i, j, m in sorted(rows):
        open_ = out.pop((i, j), None)
        whole = (open_[0], open_[1], open_[2] + m) if open_ else (i, j, m)
        out[whole[0] + whole[2], whole[1] + whole[2]] = whole
    return [(i, j, m + gram - 1) for i, j, m in out.values()]


def _parts(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair_id, part, same, i0, i1, j0, j1): the parts of each pair in order."""
    kind = dict(sizes.dtypes)["pair_id"]
    listed = blocks.groupBy("pair_id").agg(F.collect_list(F.struct("i", "j", "m")).alias("blocks"))
    rows = sizes.join(listed, "pair_id", "left").select("pair_id", "n_old", "n_new", "blocks")
    out = pa.schema([("same", pa.bool_()), *[(c, pa.int64()) for c in ("part", "i0", "i1", "j0", "j1")]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (n_old, n_new, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                cuts = certain(chained(_joined([(b["i"], b["j"], b["m"]) for b in found or ()])), n_old, n_new)
                made, i, j = [], 0, 0
                for x, y, n in [*cuts, (n_old, n_new, 0)]:
                    if x > i or y > j:
                        made.append((False, i, x, j, y))
                    if n:
                        made.append((True, x, x + n, y, y + n))
                    i, j = x + n, y + n
                same, *places = zip(*made) if made else ([], [], [], [], [])
                columns = [pa.array(same, pa.bool_()), pa.array(range(len(made)), pa.int64()), *[pa.array(p, pa.int64()) for p in places]]
                pair = batch.column(0).take(pa.array([at] * len(made), pa.int32()))
                yield pa.RecordBatch.from_arrays([pair, *columns], names=["pair_id", *out.names])

    return rows.mapInArrow(kernel, f"pair_id {kind}, same boolean, part long, i0 long, i1 long, j0 long, j1 long")


_CHUNK = pa.struct([("op", pa.string()), ("text", pa.string())])


def _solved(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and chunks of rows with ``old`` and ``new`` as words with blanks between, some pairs at a time."""
    def listed(text: str | None) -> list[str]:
        return text.split(" ") if text else []

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, ends, ops, texts = 0, [0], [], []
            for at in range(batch.num_rows):
                script = middle(listed(batch.column(len(keys))[at].as_py()), listed(batch.column(len(keys) + 1)[at].as_py()))
                ops += [op for op, _ in script]
                texts += [w for _, w in script]
                ends.append(len(ops))
                if len(ops) >= 64 * CELL or at + 1 == batch.num_rows:
                    flat = pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(texts, pa.string())], fields=list(_CHUNK))
                    here = [batch.column(k).slice(done, at + 1 - done) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays(
                        [*here, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*keys, "chunks"]
                    )
                    done, ends, ops, texts = at + 1, [0], [], []

    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return rows.select(*keys, "old", "new").mapInArrow(kernel, f"{fields}, chunks {CHUNKS}")


def diff_long(pairs: DataFrame) -> DataFrame:
    """Word diff of pairs (pair_id, old, new) as rows pair_id, part, piece, chunks: array of (op, text).

    In the order of part and piece the chunks are a minimal script, inserts before deletes inside one
    change. A part that is equal on both sides comes in pieces of at most ``CELL`` words; a part that
    differs, and a pair of up to ``WHOLE`` cells, is one piece. Pairs without words have no rows.
    ``pair_id`` must be unique.
    """
    flat = pairs.select("pair_id", *[collapse_space(F.coalesce(c, F.lit(""))).alias(c) for c in ("old", "new")])
    # a filter on a row's id stays above what makes the texts, which else is done once more for each condition
    flat = flat.withColumn("_id", F.monotonically_increasing_id())

    def n_words(c: str) -> Column:
        return F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1

    known = F.col("_id") >= 0
    short = F.greatest(n_words("old"), n_words("new")) <= WHOLE * CELL
    some = flat.filter(known & short & ((F.col("old") != "") | (F.col("new") != "")))
    zero = F.lit(0).cast("long")
    whole = _solved(some, "pair_id").select("pair_id", zero.alias("part"), zero.alias("piece"), "chunks")
    return whole.unionByName(_cut(flat.filter(known & ~short).drop("_id")))


def _cut(pairs: DataFrame) -> DataFrame:
    """The rows of ``diff_long`` for pairs of more words, by certain cuts."""
    cells = _cells(pairs)
    size = F.max(F.when(F.col("side") == 0, F.col("n_words")))
    other = F.max(F.when(F.col("side") == 1, F.col("n_words")))
    zero = F.lit(0)
    sizes = cells.groupBy("pair_id").agg(F.coalesce(size, zero).alias("n_old"), F.coalesce(other, zero).alias("n_new"))
    # what fits in a cell needs no cuts
    parts = _parts(_blocks(cells.filter(F.col("n_words") > CELL)), sizes)
    # equal parts are read from the old side only
    spans = F.when(F.col("same"), F.array(F.struct(F.lit(0).alias("side"), F.col("i0").alias("lo"), F.col("i1").alias("hi")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("i0").alias("lo"), F.col("i1").alias("hi")),
                F.struct(F.lit(1).alias("side"), F.col("j0").alias("lo"), F.col("j1").alias("hi")))
    )
    wanted = parts.select("pair_id", "part", "same", F.inline(spans)).filter("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL)))
    )
    first = F.greatest(F.col("lo") - F.col("cell") * CELL, F.lit(0)).cast("int")
    last = F.least(F.col("hi") - F.col("cell") * CELL, F.lit(CELL)).cast("int")
    pieces = wanted.join(cells.select("pair_id", "side", F.col("cell").cast("long").alias("cell"), "words"), ["pair_id", "side", "cell"]).select(
        "pair_id", "part", "same", "side", "cell", F.slice("words", first + 1, last - first).alias("w")
    )
    equal = pieces.filter("same").select("pair_id", "part", F.col("cell").alias("piece"), _chunks("equal", F.col("w")).cast(CHUNKS).alias("chunks"))

    def side(n: int):
        found = F.array_sort(F.collect_list(F.when(F.col("side") == n, F.struct("cell", "w"))))
        return F.array_join(F.flatten(F.transform(found, lambda x: x["w"])), " ")

    gaps = keep_parallel(pieces.filter("NOT same").groupBy("pair_id", "part").agg(side(0).alias("old"), side(1).alias("new")), "pair_id", "part")
    solved = _solved(gaps, "pair_id", "part")
    return equal.unionByName(solved.select("pair_id", "part", F.lit(0).cast("long").alias("piece"), "chunks"))
