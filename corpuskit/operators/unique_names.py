"""Collision-free names for whole tables.

The rule is sequential: the first row keeps its name, the next one of the same name takes the
first free suffix, and a made-up name may meet a real one that comes later or came before.
Nothing here runs row by row. Per name, rows are numbered; a number is closed for made-up names
where a real row of exactly that name comes first. Which numbers are closed depends only on
smaller numbers, so the closed set is found by repeating one join until it no longer changes
(once or twice in practice), and the suffix of every row follows from counting closed numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import number_rows, running_sums
from corpuskit.session import cut_lineage

FORMATS = {
    " (n)": (r"^(.*) \(([1-9][0-9]{0,17})\)$", " (", ")"),
    "-n": (r"^(.*)-([1-9][0-9]{0,17})$", "-", ""),
    "_n": (r"^(.*)_([1-9][0-9]{0,17})$", "_", ""),
}


def _real_numbers(occ: DataFrame, fmt: str, first: int) -> DataFrame:
    """(base, n, p, key): real names that look like a made-up name of another present name."""
    pattern = FORMATS[fmt][0]
    heads = occ.filter(F.col("_k") == 1).select("_key", F.col("_pos").alias("_p"))
    parsed = heads.select(
        F.regexp_extract("_key", pattern, 1).alias("_base"),
        F.regexp_extract("_key", pattern, 2).try_cast("bigint").alias("_n"),
        "_p",
        F.col("_key").alias("_own"),
    ).filter((F.col("_base") != "") & (F.col("_n") >= first))
    return parsed.join(heads.select(F.col("_key").alias("_base")), "_base", "left_semi")


def unique_names(
    df: DataFrame, name: str, pos: str, out: str, fmt: str = " (n)",
    ignore_case: bool = False, avoid_all: bool = False,
) -> DataFrame:
    """Add ``out``: the name made unique in ``pos`` order (an integer column).

    ``avoid_all`` keeps made-up names away from every real name, also from later ones.
    """
    key = F.lower(F.col(name)) if ignore_case else F.col(name)
    _, left, right = FORMATS[fmt]
    base = df.withColumn("_key", key).withColumn("_pos", F.col(pos))
    occ = number_rows(base, ["_key"], "_pos", out="_k")
    real = _real_numbers(occ, fmt, 2)
    if real.isEmpty():
        return _finish(occ.withColumn("_s", F.col("_k")), df, name, out, left, right)

    occ, real = cut_lineage(occ), cut_lineage(real.withColumn("_kept", F.lit(True)))
    rows = occ.join(real.select(F.col("_base").alias("_key")).distinct(), "_key", "left_semi").select(
        F.col("_key").alias("_base"), "_k", F.col("_pos").alias("_q")
    )
    while not avoid_all:
        bumped = real.filter(~F.col("_kept")).select(F.col("_own").alias("_base"), F.lit(1).alias("_g"))
        counted = running_sums(
            real, ["_base"], "_n", {"_c": F.col("_kept").cast("bigint")}
        ).withColumn("_below", F.col("_c") - F.col("_kept").cast("bigint"))
        wanted = counted.join(bumped, "_base", "left").withColumn(
            "_k", F.col("_n") - F.col("_below") - F.coalesce(F.col("_g"), F.lit(0))
        )
        judged = wanted.join(rows, ["_base", "_k"], "left").select(
            "_base", "_n", "_p", "_own", F.col("_kept").alias("_was"),
            F.coalesce(F.col("_p") < F.col("_q"), F.lit(True)).alias("_kept"),
        )
        judged = cut_lineage(judged)
        real = judged.drop("_was")
        if judged.filter(F.col("_was") != F.col("_kept")).isEmpty():
            break

    bumped = real.filter(~F.col("_kept")).select(F.col("_own").alias("_key"), F.lit(1).alias("_g"))
    ranked = occ.join(bumped, "_key", "left").withColumn(
        "_r", F.col("_k") + F.coalesce(F.col("_g"), F.lit(0))
    )
    closed = number_rows(real.filter("_kept"), ["_base"], "_n", out="_i").select(
        F.col("_base").alias("_key"),
        ((F.col("_n") - F.col("_i") + 1) * 2).alias("_at"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    # thresholds and rows in one order: a row counts the thresholds at or below its number
    seats = ranked.filter("_r >= 2").select(
        "_key", (F.col("_r") * 2 + 1).alias("_at"), F.lit(0).cast("bigint").alias("_one")
    )
    shift = running_sums(
        closed.unionByName(seats.join(closed.select("_key").distinct(), "_key", "left_semi")),
        ["_key"], "_at", {"_shift": F.col("_one")},
    ).filter("_one = 0").select("_key", ((F.col("_at") - 1) / 2).cast("bigint").alias("_r"), "_shift")
    done = ranked.join(shift, ["_key", "_r"], "left").withColumn(
        "_s", F.col("_r") + F.when(F.col("_r") >= 2, F.coalesce(F.col("_shift"), F.lit(0))).otherwise(0)
    )
    return _finish(done, df, name, out, left, right)


def _finish(done: DataFrame, df: DataFrame, name: str, out: str, left: str, right: str) -> DataFrame:
    made: Column = F.concat(F.col(name), F.lit(left), F.col("_s").cast("string"), F.lit(right))
    return done.select(
        *[c for c in df.columns], F.when(F.col("_s") == 1, F.col(name)).otherwise(made).alias(out)
    )


def free_names(wanted: DataFrame, existing: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """The first of ``name.ext``, ``name (1).ext``, … not in the target folder, ignoring case.

    ``existing`` (folder, name) is fixed; each wanted row (folder, name, pos) also takes its name.
    A numbered name also keeps clear of every name that is wanted as such, in whatever order.
    """
    ext = r"^(.+?)(\.[^.]*)?$"

    def parts(c):
        return F.regexp_extract(c, ext, 1), F.regexp_extract(c, ext, 2)

    stem, tail = parts(F.col(name))
    w = wanted.withColumns({"_stem": F.lower(stem), "_tail": F.lower(tail)})
    grp = ["folder", "_stem", "_tail"]
    w = number_rows(w, grp, pos, out="_k")
    e_stem, e_tail = parts(F.lower("name"))
    taken = existing.select("folder", e_stem.alias("_es"), e_tail.alias("_tail")).distinct()
    suffix = r"^(.*) \(([1-9][0-9]{0,17})\)$"
    asked = w.select("folder", F.col("_stem").alias("_es"), "_tail")
    numbered = taken.unionByName(asked).distinct().select(
        "folder", F.regexp_extract("_es", suffix, 1).alias("_stem"), "_tail",
        F.regexp_extract("_es", suffix, 2).try_cast("bigint").alias("_n"),
    ).filter("_n IS NOT NULL")
    plain = taken.select("folder", F.col("_es").alias("_stem"), "_tail", F.lit(0).cast("bigint").alias("_n"))
    groups = w.select(*grp).distinct()
    closed = plain.unionByName(numbered).distinct().join(groups, grp, "left_semi")
    closed = number_rows(closed, grp, "_n", out="_i").select(
        *grp, ((F.col("_n") - F.col("_i") + 1) * 2).alias("_at"), F.lit(1).cast("bigint").alias("_one")
    )
    seats = w.select(*grp, ((F.col("_k") - 1) * 2 + 1).alias("_at"), F.lit(0).cast("bigint").alias("_one"))
    shift = running_sums(closed.unionByName(seats), grp, "_at", {"_shift": F.col("_one")}).filter(
        "_one = 0"
    ).select(*grp, ((F.col("_at") - 1) / 2 + 1).cast("bigint").alias("_k"), "_shift")
    n = F.col("_k") - 1 + F.col("_shift")
    s, t = parts(F.col(name))
    made = F.concat(s, F.lit(" ("), n.cast("string"), F.lit(")"), t)
    return w.join(shift, [*grp, "_k"]).select(
        *wanted.columns, F.when(n == 0, F.col(name)).otherwise(made).alias("free_name")
    )
