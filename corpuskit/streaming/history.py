"""The state that do / undo / redo logs leave, for keys of any size.

The log of a key is cut in blocks that begin with a ``do``. As a ``do`` drops all that could be redone, all a
block needs to know of what came before is how many steps can be undone (``before``). For a ``before`` larger
than the block's deepest undo the result only shifts; for smaller ones it is a short table. So blocks
are summed up side by side, a walk over the tables gives every block its ``before``, and a second look at
the blocks finds the value on top: that of the last ``do`` at the final depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import running_sums

#: edits of a block
SIZE = 4096

DO, UNDO, REDO = 0, 1, 2


def _deepest(ops: list[int]) -> int:
    """How far below its first depth a block's undos would go if there was no end."""
    at = top = low = 0
    for op in ops:
        if op == DO:
            at += 1
            top = at
        elif op == UNDO:
            at -= 1
            low = min(low, at)
        elif at < top:
            at += 1
    return -low


def table(ops: list[int], depth: int | None) -> tuple[list[int], list[int], list[int]]:
    """(steps that can be undone, that can be redone, steps lost to the limit) for each ``before`` from 0 on.

    Without a limit, beyond the end of the table the first is larger by as much as ``before`` is.
    """
    at = np.arange((_deepest(ops) if depth is None else depth) + 1)
    top, lost = at.copy(), np.zeros_like(at)
    for op in ops:
        if op == DO:
            at = at + 1
            if depth is not None:
                lost += at > depth
                at = np.minimum(at, depth)
            top = at
        elif op == UNDO:
            at = np.maximum(at - 1, 0)
        else:
            at = np.minimum(at + 1, top)
    return at.tolist(), (top - at).tolist(), lost.tolist()


def walked(parts: list[dict]) -> tuple[list[int], list[int], int, int, int]:
    """(before and steps lost so far, per block; undo depth, redo depth and place of the top at the end)."""
    befores, losts, at, redo, lost = [], [], 0, 0, 0
    for p in parts:
        befores.append(at)
        losts.append(lost)
        i = min(at, len(p["undo"]) - 1)
        at, redo, lost = p["undo"][i] + (at - i), p["redo"][i], lost + p["lost"][i]
    return befores, losts, at, redo, at + lost


def last_at(ops: list[int], before: int, lost: int, depth: int | None, place: int) -> int | None:
    """The last ``do`` of a block that wrote the ``place``-th step, if any."""
    at = top = before
    found = None
    for i, op in enumerate(ops):
        if op == DO:
            at += 1
            if depth is not None and at > depth:
                at, lost = depth, lost + 1
            top = at
            if at + lost == place:
                found = i
        elif op == UNDO:
            at = max(at - 1, 0)
        else:
            at = min(at + 1, top)
    return found


def replayed(log: DataFrame, key: str, us: str, tie: str, op: str, value: str, depth: int | None, step: int) -> DataFrame:
    """One row per key: ``key``, value, undo_depth, redo_depth after its events in the order of (us, tie).

    ``op`` is undo, redo or else an edit; at most ``depth`` steps can be undone (None: all). ``step`` is the
    length of the stretches of ``us`` in which edits are counted. A null key is a key.
    """
    code = F.when(F.col(op) == "undo", UNDO).when(F.col(op) == "redo", REDO).otherwise(DO)
    events = log.select(
        F.struct(F.col(key).alias("key")).alias("grp"), F.col(us).alias("us"), F.col(tie).alias("tie"), code.alias("op"), F.col(value).alias("value"),
    )
    counted = running_sums(events, ["grp"], "us", {"edits": (F.col("op") == DO).cast("bigint")}, step, tie=("tie",))
    block = F.floor(F.greatest(F.col("edits") - 1, F.lit(0)) / SIZE)
    listed = F.array_sort(F.collect_list(F.struct("us", "tie", "op", "value")))
    blocks = counted.groupBy("grp", block.alias("block")).agg(listed.alias("es")).select(
        "grp", "block", F.col("es.op").alias("ops"), F.col("es.value").alias("values"), F.col("es.us").alias("us"), F.col("es.tie").alias("tie")
    )
    grp = blocks.schema["grp"].dataType.simpleString()
    longs, ints = "array<bigint>", pa.list_(pa.int64())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*(table(ops, depth) for ops in b.column(2).to_pylist()), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(m, ints) for m in made]], names=["grp", "block", "undo", "redo", "lost"])

    tables = blocks.select("grp", "block", "ops").mapInArrow(sums, f"grp {grp}, block bigint, undo {longs}, redo {longs}, lost {longs}")
    per_key = tables.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("block", "undo", "redo", "lost"))).alias("parts"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).to_pylist()
            made = list(zip(*(([p["block"] for p in parts], *walked(parts)) for parts in lists), strict=True)) or [[]] * 6
            kinds = [ints, ints, ints, pa.int64(), pa.int64(), pa.int64()]
            names = ["blocks", "befores", "losts", "undo_depth", "redo_depth", "place"]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m, k) for m, k in zip(made, kinds, strict=True)]], names=["grp", *names])

    ends = per_key.mapInArrow(
        walk, f"grp {grp}, blocks {longs}, befores {longs}, losts {longs}, undo_depth bigint, redo_depth bigint, place bigint"
    )
    entries = ends.select("grp", "undo_depth", "redo_depth", "place", F.inline(F.arrays_zip(
        F.col("blocks").alias("block"), F.col("befores").alias("before"), F.col("losts").alias("lost"),
    )))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(6, 10)), strict=True)
            at = [last_at(ops, before, lost, depth, place) for ops, before, lost, place in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(at, pa.int32())], names=[*kept, "at"])

    kept = ["grp", "undo_depth", "redo_depth", "values", "us", "tie"]
    joined = blocks.join(entries, ["grp", "block"]).select(*kept, "ops", "before", "lost", "place")
    kinds = dict(joined.dtypes)
    found = joined.mapInArrow(tops, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "at int"])).select(
        "grp", "undo_depth", "redo_depth", F.when(F.col("at").isNotNull(), F.struct(
            F.get("us", F.col("at")).alias("us"), F.get("tie", F.col("at")).alias("tie"), F.get("values", F.col("at")).alias("value"),
        )).alias("top"),
    )
    return found.groupBy("grp").agg(
        F.max_by("top", F.struct("top.us", "top.tie")).alias("top"), F.first("undo_depth").alias("undo_depth"), F.first("redo_depth").alias("redo_depth"),
    ).select(
        F.col("grp.key").alias(key), F.when(F.col("undo_depth") > 0, F.col("top.value")).alias("value"), "undo_depth", "redo_depth",
    )
