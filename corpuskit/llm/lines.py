"""Line dedup by winnowing, in DataFrame operations only.

A window is a shortest run of lines that holds a number of words (50): from a line on, or up to a line.
Its fingerprint is the smallest of its line hashes; the places of these minima are the positions that
winnowing selects. Positions join on the fingerprint, and only windows around positions that another
one shares go on. Of those, windows with the same hash of all their lines are the same passage. The first
place of a passage is its origin, all later ones repeat it.

A match extends both ways, line by line, by the windows around it: a repeated run of 50 words or more
begins with a window from its first line on and ends with one up to its last line, so the union of
repeated windows is the whole run. It is deleted, and the origin stays.

Every position is compared with the origin only, so a passage in a third of all documents costs as
much as its occurrences, not their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh, quoted, stored, text_key

WORDS = 50
SPACES = " \t\x0b\x0c\r"
WORD = r"[^ \t\n\x0B\f\r]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, first, last, mark, fingerprint, content_1, content_2) per window of each document.

    ``docs`` has doc_id, key and text. Lines without a word take no part but lie inside windows.
    Lines are compared without the white space at their ends. ``mark`` is the line of the fingerprint.
    """
    facts = docs.select("doc_id", "key", F.filter(
        F.transform(_lines(F.col("text")), lambda line, at: F.struct(
            at.alias("at"), F.regexp_count(line, F.lit(WORD)).alias("words"),
            F.xxhash64(F.btrim(line, F.lit(SPACES))).alias("hash"),
        )), lambda x: x["words"] > 0).alias("full"))

    def taken(near: Column) -> Column:
        return F.aggregate(
            near,
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
            lambda acc, x: F.when(acc["words"] >= words, acc).otherwise(
                F.struct((acc["words"] + x["words"]).alias("words"), (acc["lines"] + 1).alias("lines"))
            ),
        )

    # a window has at most as many lines as words, as each of its lines has one
    def onward(_: Column, i: Column) -> Column:
        t = taken(F.slice("full", i + 1, words))
        return F.struct(t["words"].alias("words"), i.alias("i"), t["lines"].alias("n"))

    def back(_: Column, i: Column) -> Column:
        first = F.greatest(i - (words - 2), F.lit(1))
        t = taken(F.reverse(F.slice("full", first, i + 2 - first)))
        return F.struct(t["words"].alias("words"), (i + 1 - t["lines"]).alias("i"), t["lines"].alias("n"))

    found = facts.select("doc_id", "key", "full", F.concat(F.transform("full", onward), F.transform("full", back)).alias("found"))
    whole = found.select("doc_id", "key", F.transform(
        F.array_distinct(F.filter("found", lambda w: w["words"] >= words)), lambda w: F.slice("full", w["i"] + 1, w["n"]),
    ).alias("found"))
    # the plain explode would first filter by the array's size and so compute all of it once more
    each = whole.select("doc_id", "key", F.explode_outer("found").alias("w")).filter("w is not null")
    least = F.array_min("w.hash")
    return each.select(
        "doc_id", "key", F.col("w.at")[0].alias("first"), F.element_at("w.at", -1).alias("last"),
        F.get("w.at", (F.array_position("w.hash", least) - 1).cast("int")).alias("mark"), least.alias("fingerprint"),
        F.xxhash64("w.hash").alias("content_1"), F.xxhash64(F.lit(1), "w.hash").alias("content_2"),
    )


def repeated_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, runs): per document the runs of lines (first, last) that repeat earlier ones.

    Earlier is by doc_id (nulls last), then the text's key, then the line. Inside one document a
    window repeats another only if it begins behind its end.
    """
    passage = ["fingerprint", "content_1", "content_2"]
    every = stored(windows(docs, words), "windows")
    # a minimum's line is one position, however many windows it is the minimum of
    position = F.xxhash64("doc_id", "key", "mark")
    shared = every.groupBy("fingerprint").agg(F.min(position).alias("one"), F.max(position).alias("other")).filter("one <> other")
    places = stored(every.join(shared, "fingerprint", "left_semi"), "positions")
    origins = places.groupBy(*passage).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key", "first", "last")).alias("origin"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 1").drop("n")
    # stored, so that the join below splits a passage that a large part of all documents has
    origins = stored(origins, "origins")
    same = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("key") == F.col("origin.key"))
    later = places.join(origins, passage).filter(~same | (F.col("first") > F.col("origin.last"))).select(
        "doc_id", "key", "first", "last"
    )
    order = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        later.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                count: str | None = None, mark: str = "n_removed") -> DataFrame:
    """The documents with later repeated runs of lines deleted from ``text``, and how many lines went in ``mark``.

    Only runs of at least ``words`` words go. A document all of whose lines go has the empty text;
    a null text stays null. Rows alike in id and text count as one document and are treated alike.
    Null ids come last in the order. ``count`` names a column of text lengths to renew. Other columns
    stay; one named like ``mark`` gives way. No rows give none.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[quoted(c).alias(n) for c, n in at.items()])
    slim = own.select(F.col(at[doc_id]).alias("doc_id"), text_key(at[text]).alias("key"), F.col(at[text]).alias("text"))
    runs = repeated_runs(slim.filter("text is not null"), words)
    keyed = own.withColumn("key", text_key(at[text]))
    joined = keyed.join(
        runs.withColumnsRenamed({"doc_id": "run_id", "key": "run_key"}),
        F.col(at[doc_id]).eqNullSafe(F.col("run_id")) & (F.col("key") == F.col("run_key")), "left",
    ).withColumn("lines", F.when(F.col("runs").isNotNull(), _lines(F.col(at[text]))))
    n = F.size("runs")

    def part(k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get("runs", k - 1)["last"] + 1)
        stop = F.when(k == n, F.size("lines")).otherwise(F.get("runs", k)["first"])
        return F.slice("lines", begin + 1, stop - begin)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), part)), "\n")
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["last"] - r["first"] + 1)
    done = joined.withColumn(at[text], F.when(F.col("runs").isNull(), F.col(at[text])).otherwise(left)).withColumn(
        "n_removed", F.coalesce(removed, F.lit(0).cast("bigint"))
    )
    if count is not None:
        done = done.withColumn(at[count], F.length(at[text]).cast(docs.schema[count].dataType))
    keep = [c for c in docs.columns if c.lower() != mark.lower()]
    return done.select(*[F.col(at[c]).alias(c) for c in keep], F.col("n_removed").alias(mark))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``dedup_lines`` for the columns of documents: text and n_chars renewed, nothing added."""
    count = "n_chars" if "n_chars" in docs.columns else None
    mark = fresh(docs, "n_removed")
    return dedup_lines(docs, count=count, mark=mark).drop(mark)
