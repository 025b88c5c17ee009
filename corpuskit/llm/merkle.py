"""A Merkle manifest of a documents table: leaf, group root, root and membership proof of every row.

Leaves are numbered per group (``lang``) by a range sort, per-partition counts and offsets, so a group
that holds most rows is many partitions. Every aligned block of 512 neighbouring nodes keeps its level
as one string of hexadecimal digests. Fixed-width substrings of eight digests are hashed to the parents'
string, up to three levels; a node's siblings are the substrings that flank it in its run. The blocks'
own digests are the nodes of the next round, until each group has one root; the group roots are then
the leaves of one more tree. A round has a 512th of the rows of the one before, so there are few.

All of it is SQL functions; a task holds one block (32 KB a level) at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import quoted, stored

FANOUT = 8
HEX = 64
RUN = FANOUT * HEX
#: levels a block holds, and the nodes on its lowest one
STEPS = 3
BLOCK = FANOUT ** STEPS

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of the values, each as byte count, colon and text, or a dash if null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]))


def parents(level: Column) -> Column:
    """The string of the digests one level up; the last run may have fewer than eight nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / RUN).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: digest(F.substring(level, i * RUN + 1, F.lit(RUN)))), "")


def flanks(level: Column, at: Column) -> Column:
    """(left, right): the other digests of the run that node ``at`` (from 0) of a level is in."""
    run = (at - at % FANOUT) * HEX
    place = (at % FANOUT) * HEX
    return F.struct(
        F.substring(level, run + 1, place).alias("left"),
        F.substring(level, run + place + HEX + 1, RUN - HEX - place).alias("right"),
    )


def _path(at: Column) -> Column:
    """The flanks of node ``at`` of a block on the levels the block has, lowest first."""
    powers = [FANOUT ** i for i in range(STEPS)]
    every = F.array(*[flanks(F.col(f"level{i}"), F.floor(at / p).cast("int")) for i, p in enumerate(powers)])
    return F.slice(every, F.lit(1), F.col("steps"))


def proof(path: Column) -> Column:
    """The digest of all siblings on the way to the root, left to right on each level."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda h, x: digest(F.concat(x["left"], h, x["right"])))


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos``, a row's place (from 0) in its group by ``order``, ``total``, the group's rows, and ``row``, a number of its own.

    ``order`` should tell all rows apart, so that equal ones can be dealt to several partitions.
    """
    placed = stored(
        nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .withColumn("row", F.monotonically_increasing_id()), "placed"
    ).withColumn("part", F.shiftright("row", 33))
    # one row per partition and group; both are sorted, so there are at most as many as partitions and groups together
    counts = placed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        group, "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("total"),
    )
    return placed.join(starts, [group, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop(
        "part", "shift"
    )


def _depth(total: Column) -> Column:
    """The levels above the leaves: the smallest number of which eight to the power reaches ``total``."""
    depth = F.lit(0)
    for i in range(1, 21):
        depth = F.when(total > FANOUT ** (i - 1), i).otherwise(depth)
    return depth


def _blocks(nodes: DataFrame, extra: list[str], done: int) -> DataFrame:
    """One row per (grp, block): the nodes in order, the levels' strings and the block's digest ``h``."""
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.max("depth").alias("depth"),
        F.array_sort(F.collect_list(F.struct("pos", "h", *extra))).alias("nodes"),
    )
    out = grouped.withColumn("steps", F.least(F.lit(STEPS), F.greatest(F.col("depth") - done, F.lit(0)))).withColumn(
        "level0", F.array_join(F.col("nodes.h"), "")
    )
    for i in range(STEPS):
        low = F.col(f"level{i}")
        out = out.withColumn(f"level{i + 1}", F.when(F.col("steps") > i, parents(low)).otherwise(low))
    return out.withColumnRenamed(f"level{STEPS}", "h")


def _ended(i: int) -> Column:
    """Whether a block of round ``i`` is the top of its group's tree."""
    return F.col("depth") <= STEPS * (i + 1)


def tree(nodes: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(rounds, roots) of the trees over ``nodes`` (grp, pos, total, h and ``extra`` columns).

    Each round has the blocks of one stage of the climb, the first one the ``nodes``; ``roots`` has grp
    and h. ``nodes`` are read once.
    """
    level = nodes.withColumn("depth", _depth(F.col("total")))
    rounds: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        i = len(rounds)
        rounds.append(stored(_blocks(level, extra if not rounds else [], STEPS * i), "blocks"))
        ended = rounds[-1].filter(_ended(i)).select("grp", "h")
        roots = ended if roots is None else roots.union(ended)
        level = rounds[-1].filter(~_ended(i)).select("grp", F.col("block").alias("pos"), "h", "depth")
        # the number of rounds is the depth of the largest group; one row at most comes here
        if level.isEmpty():
            return rounds, roots


def _kids(blocks: DataFrame, made) -> DataFrame:
    """A row per node of each block: the struct that ``made`` gives for a node's place, and the block's root columns."""
    return blocks.select("subroot", "root", F.inline(F.transform(F.sequence(F.lit(0), F.size("nodes") - 1), made)))


def descended(rounds: list[DataFrame], over: DataFrame) -> DataFrame:
    """The lowest blocks with ``above``, ``subroot`` and ``root``.

    ``over`` has these per grp; ``above`` are the flanks from there up. It only joins the one top block of
    each group, and what it adds goes down block by block, so a group of any size stays spread.
    """
    above: DataFrame | None = None
    for i, r in reversed(list(enumerate(rounds))):
        now = r.filter(_ended(i)).join(over, "grp")
        if above is not None:
            kids = _kids(above, lambda at: F.struct(
                F.col("grp"), (F.col("block") * BLOCK + at).alias("block"), F.concat(_path(at), F.col("above")).alias("above"),
            ))
            now = now.unionByName(r.join(kids, ["grp", "block"]))
        above = now
    return above


def manifest(docs: DataFrame, fields: list[str], group: str, order: str, changed: dict[str, Column], when: Column) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``fields``. Each value of ``group`` (null first, then by its UTF-8 bytes) has a
    tree over its leaves by ``order`` (nulls first, equal ones by their leaf); the root is that of the tree
    over the groups' roots. Where ``when`` holds, the leaf is computed anew with the ``changed`` columns, and
    folded with the original siblings; ``verified`` tells whether that still gives the root.

    Repeated rows are leaves of their own. No rows give none. Other columns are not read.
    """
    plain = leaf_digest([quoted(f) for f in fields])
    altered = leaf_digest([changed.get(f, quoted(f)) for f in fields])
    leaves = stored(docs.select(
        # '' for null, as that sorts before all
        F.coalesce(F.concat(F.lit("."), quoted(group).cast("string")), F.lit("")).alias("grp"),
        quoted(order).alias("id"), plain.alias("h"), F.when(when, altered).alias("other"),
        F.monotonically_increasing_id().alias("nth"),
    ), "leaves")
    rounds, roots = tree(numbered(leaves, "grp", ["id", "h", "nth"]).drop("nth", "row"), ["id", "other"])
    tops = numbered(stored(roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "h"), "roots"), "grp", ["id"])
    top_rounds, root = tree(tops.drop("row"), ["id"])
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = descended(top_rounds, root.select("grp", F.lit("").alias("subroot"), F.col("h").alias("root"), none.alias("above")))
    over = _kids(top, lambda at: F.struct(
        F.col("nodes")[at]["id"].alias("grp"), F.col("nodes")[at]["h"].alias("own"),
        F.concat(_path(at), F.col("above")).alias("above"),
    )).select("grp", F.col("own").alias("subroot"), "root", "above")
    rows = _kids(descended(rounds, over), lambda at: F.struct(
        F.col("nodes")[at]["id"].alias("id"), F.col("nodes")[at]["h"].alias("leaf"), F.col("nodes")[at]["other"].alias("other"),
        F.concat(_path(at), F.col("above")).alias("path"),
    ))
    folded = rows.withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return folded.select(
        F.col("id").alias(order), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of a documents table; every third id (by CRC-32) is folded with its text in lower case."""
    low = F.translate("text", UPPER, UPPER.lower())
    every_third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": low},
        F.coalesce(every_third, F.lit(False)),
    )
