"""Which events pass a rate limit, for keys of any size.

Whether an event passes depends on the last one that did, so a loop over a key cannot be cut. But a stretch
of time, as a function of the last time let through before it, is simple: the first event that is late
enough is let through, and from there on everything is settled. The function is a list of (event time, last
time let through if that event is the first), and only events in the stretch's first ``seconds``, and the first one
after those, can be first. Lists of neighbouring stretches combine to a list of the same form.

So stretches of ``SLABS`` times the limit are summed up side by side, ``RUN`` of them to a longer one, and
per key a short walk over the longer ones is all that is in order. The walk's results go back down.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLABS = 16
RUN = 256

#: before all times
NEVER = -(1 << 62)


def summary(times: list[int], wait: int, start: int) -> tuple[list[int], list[int]]:
    """(times that can be the first let through, last time let through after each) of sorted times."""
    last = list(times)
    # only the end of the chain that begins at each event is kept, so later events come first
    for i in range(len(times) - 1, -1, -1):
        j = bisect_left(times, times[i] + wait, i)
        if j < len(times):
            last[i] = last[j]
    n = min(len(times), bisect_left(times, start + wait) + 1)
    firsts, lasts = [], []
    for t, e in zip(times[:n], last[:n], strict=True):
        if not firsts or firsts[-1] != t:
            firsts.append(t)
            lasts.append(e)
    return firsts, lasts


def after(firsts: list[int], lasts: list[int], wait: int, before: int) -> int:
    """The last time let through after a stretch, from the one before it."""
    i = bisect_left(firsts, before + wait)
    return lasts[i] if i < len(firsts) else before


def combined(parts: list[tuple[list[int], list[int]]], wait: int, start: int) -> tuple[list[int], list[int]]:
    """The summary of neighbouring stretches that begin at ``start`` from theirs, in order."""
    firsts: list[int] = []
    lasts: list[int] = []
    for f, e in parts:
        lasts = [after(f, e, wait, t) for t in lasts]
        # an event of this part is the first only if all before are too early
        if not firsts or firsts[-1] < start + wait:
            firsts, lasts = firsts + f, lasts + e
    n = min(len(firsts), bisect_left(firsts, start + wait) + 1)
    return firsts[:n], lasts[:n]


def walked(parts: list[tuple[list[int], list[int]]], wait: int, before: int) -> list[int]:
    """The last time let through before each part."""
    out = []
    for f, e in parts:
        out.append(before)
        before = after(f, e, wait, before)
    return out


def passing(times: list[int], wait: int, before: int) -> list[int]:
    """Places of the sorted times that are let through."""
    out = []
    i = bisect_left(times, before + wait)
    while i < len(times):
        out.append(i)
        i = bisect_left(times, times[i] + wait, i)
    return out


def _rows(df: DataFrame, columns: list[str], fn: Callable, names: list[str], kinds: list[str]) -> DataFrame:
    """Add columns ``names`` that ``fn`` makes from the values of ``columns``, row by row."""
    keep = [c for c in df.columns if c not in columns or c in ("grp", "block", "span")]
    types = dict(df.dtypes)
    arrow = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            out = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(v, arrow[k]) for v, k in zip(out, kinds, strict=True)]],
                names=[*keep, *names],
            )

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{n} {k}" for n, k in zip(names, kinds, strict=True)]])
    return df.mapInArrow(run, schema)


def _pairs(parts: list[dict]) -> list[tuple[list[int], list[int]]]:
    return [(p["firsts"], p["lasts"]) for p in parts]


def rate_limited(events: DataFrame, key: str, tie: str, us: str, seconds: float) -> DataFrame:
    """The rows of ``events`` at least ``seconds`` after the last one let through, per key.

    ``us`` holds microseconds; of events at one time the first by ``tie`` counts. A null key is a key;
    events without a time do not pass. (key, us, tie) should tell rows apart.
    """
    wait = max(1, int(seconds * 1e6))
    width, wide = wait * SLABS, wait * SLABS * RUN
    at = [
        F.struct(F.col(key).alias("key")).alias("grp"), F.floor(F.col(us) / width).alias("block"),
        F.struct(F.col(us).alias("us"), F.col(tie).alias("tie")).alias("e"),
    ]
    blocks = events.filter(F.col(us).isNotNull()).select(*at).groupBy("grp", "block").agg(
        F.array_sort(F.collect_list("e")).alias("es")
    ).select("grp", "block", F.floor(F.col("block") / RUN).alias("span"), F.col("es.us").alias("times"), F.col("es.tie").alias("ties"))
    sums = _rows(
        blocks.select("grp", "block", "span", "times"), ["block", "times"], lambda b, t: summary(t, wait, b * width),
        ["firsts", "lasts"], ["array<bigint>", "array<bigint>"],
    )
    spans = sums.groupBy("grp", "span").agg(F.array_sort(F.collect_list(F.struct("block", "firsts", "lasts"))).alias("parts"))
    long = _rows(
        spans, ["span", "parts"], lambda s, p: combined(_pairs(p), wait, s * wide), ["firsts", "lasts"], ["array<bigint>", "array<bigint>"],
    )
    keys = long.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("span", "firsts", "lasts"))).alias("parts"))

    def carried(parts: list[dict], place: str, before: int) -> tuple[list[int], list[int]]:
        return [p[place] for p in parts], walked(_pairs(parts), wait, before)

    top = _rows(keys, ["parts"], lambda p: carried(p, "span", NEVER), ["spans", "befores"], ["array<bigint>", "array<bigint>"])
    per_span = top.select("grp", F.inline(F.arrays_zip(F.col("spans").alias("span"), F.col("befores").alias("before"))))
    low = _rows(
        spans.join(per_span, ["grp", "span"]), ["parts", "before"], lambda p, b: carried(p, "block", b),
        ["blocks", "befores"], ["array<bigint>", "array<bigint>"],
    )
    per_block = low.select("grp", F.inline(F.arrays_zip(F.col("blocks").alias("block"), F.col("befores").alias("before"))))
    found = _rows(
        blocks.join(per_block, ["grp", "block"]), ["times", "before"], lambda t, b: (t, passing(t, wait, b)),
        ["times", "places"], ["array<bigint>", "array<int>"],
    )
    let = found.select("grp", F.explode("places").alias("i"), "times", "ties").select(
        "grp", F.get("times", F.col("i")).alias("_at"), F.get("ties", F.col("i")).alias("_tie")
    )
    grp = F.struct(F.col(key).alias("key"))
    return events.join(
        let, (grp == let["grp"]) & (events[us] == let["_at"]) & events[tie].eqNullSafe(let["_tie"]), "left_semi"
    )
