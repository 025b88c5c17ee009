"""Ordered computations that stay balanced when one key holds most of the rows.

A window over a key runs in one task per key. Here each key is first cut into blocks of
neighbouring positions; windows run inside (key, block), and the small table of block totals
supplies what comes from earlier blocks. The carry table only has rows for keys longer than
one block, so on ordinary data the join is against almost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192


def running_sums(
    df: DataFrame,
    keys: list[str],
    pos: str,
    sums: dict[str, Column],
    block: int = BLOCK,
    totals: dict[str, str] | None = None,
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """Add inclusive running sums in ``pos`` order per key; ``tie`` orders rows of one position.

    ``totals`` maps an output column to the sum whose whole-key total it should hold.
    """
    totals = totals or {}
    blk = F.floor(F.col(pos) / block)
    base = df.withColumns({**{f"_v_{n}": e for n, e in sums.items()}, "_blk": blk})
    part = [*keys, "_blk"]
    inside = Window.partitionBy(*part).orderBy(pos, *tie).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums})
    per_block = base.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *part,
        *[F.sum(f"_s_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.sum(f"_s_{src}").over(whole).alias(out) for out, src in totals.items()],
    )
    if not totals:
        carry = carry.filter(F.col(f"_c_{next(iter(sums))}").isNotNull())
    cond = [local[k].eqNullSafe(carry[k]) for k in part]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    joined = local.join(carry, on, "left")
    keep = [local[c] for c in df.columns if c not in sums]
    return joined.select(
        *keep,
        *[(local[n] + F.coalesce(carry[f"_c_{n}"], F.lit(0))).alias(n) for n in sums],
        *[carry[out] for out in totals],
    )


def running_max(
    df: DataFrame, keys: list[str], pos: str, values: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add inclusive running maxima in ``pos`` order per key; NULLs do not count."""
    base = df.withColumns({**{f"_v_{n}": e for n, e in values.items()}, "_blk": F.floor(F.col(pos) / block)})
    part = [*keys, "_blk"]
    inside = Window.partitionBy(*part).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: F.max(f"_v_{n}").over(inside) for n in values})
    per_block = base.groupBy(*part).agg(*[F.max(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(*part, *[F.max(f"_s_{n}").over(before).alias(f"_c_{n}") for n in values])
    some = F.coalesce(*[F.col(f"_c_{n}").isNotNull().cast("int") for n in values])
    for n in values:
        some = F.greatest(some, F.col(f"_c_{n}").isNotNull().cast("int"))
    joined = local.join(carry.filter(some > 0), part, "left")
    return joined.select(
        *[c for c in df.columns if c not in values],
        *[F.greatest(F.col(n), F.col(f"_c_{n}")).alias(n) for n in values],
    )


def number_rows(
    df: DataFrame, keys: list[str], pos: str, out: str = "rn", total: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """1-based number in ``pos`` order per key, and the row count per key if asked for."""
    totals = {total: out} if total else None
    return running_sums(df, keys, pos, {out: F.lit(1).cast("bigint")}, block, totals)


def previous_values(
    df: DataFrame, keys: list[str], pos: str, values: dict[str, str], block: int = BLOCK,
    tie: tuple[str, ...] = (),
) -> DataFrame:
    """Add the value of the row before (``out`` → source column), across block edges.

    ``tie`` orders rows of one position.
    """
    base = df.withColumn("_blk", F.floor(F.col(pos) / block))
    part = [*keys, "_blk"]
    w = Window.partitionBy(*part).orderBy(pos, *tie)
    packed = F.struct(*[F.col(c).alias(f"_p_{c}") for c in dict.fromkeys(values.values())])
    local = base.withColumn("_prev", F.lag(packed).over(w))
    last = base.groupBy(*part).agg(F.max_by(packed, F.struct(pos, *tie)).alias("_last"))
    kw = Window.partitionBy(*keys).orderBy("_blk")
    carry = last.select(*part, F.lag("_last").over(kw).alias("_carry")).filter(
        F.col("_carry").isNotNull()
    )
    on = local[part[0]].eqNullSafe(carry[part[0]])
    for k in part[1:]:
        on = on & local[k].eqNullSafe(carry[k])
    prev = F.coalesce(local["_prev"], carry["_carry"])
    return local.join(carry, on, "left").select(
        *[local[c] for c in df.columns],
        *[prev[f"_p_{src}"].alias(out) for out, src in values.items()],
    )


HOT_ROWS = 1_000_000


def keep_parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly the session's number of shuffle partitions.

    Kernels cost far more than their bytes suggest, so partitions must not be merged by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def counted_join(
    big: DataFrame, small: DataFrame, on: list[str], n: str, how: str = "left", ways: int = 64,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join to a table with one row per key that also holds how many rows the key has.

    Keys with more than ``hot_rows`` rows are spread: their rows over ``ways`` sub-keys by a hash
    of the whole row, their one partner repeated per sub-key. There are at most
    total / ``hot_rows`` such keys, which bounds what is broadcast; all other keys join plainly.
    """
    hot = small.filter(F.col(n) > hot_rows).select(*on, F.lit(True).alias("_hot"))
    seed = F.xxhash64(*[F.col(c) for c in big.columns])
    left = big.join(F.broadcast(hot), on, "left").withColumn(
        "_way", F.when(F.col("_hot"), F.pmod(seed, F.lit(ways)).cast("int")).otherwise(0)
    )
    all_ways = F.sequence(F.lit(0), F.lit(ways - 1))
    right = small.withColumn(
        "_way", F.explode(F.when(F.col(n) > hot_rows, all_ways).otherwise(F.array(F.lit(0))))
    ).drop(n)
    return left.drop("_hot").join(right, [*on, "_way"], how).drop("_way")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, tag: str) -> DataFrame:
    """First ``k`` rows per key in two steps: per sub-key of a hash of ``tag``, then over those."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tag), F.lit(64)))
    some = salted.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    ).filter(F.col("_rn") <= k).drop("_salt")
    return some.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("_rn") <= k
    ).drop("_rn")
