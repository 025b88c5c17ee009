"""Page sequences: numbering, splitting, reordering, merging, imposition.

A page table has doc_id, pos (0-based, unique per document), page_key, source_id,
source_index and rotation; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.geometry import normalize_rotation
from corpuskit.functions.names import bates_label, pad_number
from corpuskit.operators.ordered import number_rows, running_sums
from corpuskit.operators.unique_names import unique_names
from corpuskit.session import cut_lineage


def global_numbers(df: DataFrame, order: list[str], out: str = "offset") -> DataFrame:
    """0-based number over the whole table in the given total order, without a one-task sort.

    Rows are range-partitioned and sorted; the place within a partition is stored with the rows
    in the shared folder, so both readers see one and the same partitioning. Only one count per
    partition is summed up centrally, a table of at most ``spark.sql.shuffle.partitions`` rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + local).alias(out))
    )


def bates_number(pages: DataFrame, prefix: str, digits: int, start: int) -> DataFrame:
    """Labels that run on over all documents of a production, in (doc_id, pos) order."""
    numbered = global_numbers(pages, ["doc_id", "pos"], "_off")
    return numbered.withColumn("label", bates_label(prefix, digits, start, F.col("_off"))).drop("_off")


def renumber(pages: DataFrame, order: str) -> DataFrame:
    """New 0-based ``pos`` per document from an integer order column, which is dropped."""
    n = number_rows(pages.drop("pos"), ["doc_id"], order, out="_rn")
    return n.withColumn("pos", (F.col("_rn") - 1).cast("bigint")).drop("_rn", order)


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """file_no per page: every ``n`` pages start a new file (1 = individual pages)."""
    step = max(1, int(n))
    return pages.withColumn("file_no", F.floor(F.col("pos") / step))


def split_custom(pages: DataFrame, cuts: list[int]) -> DataFrame:
    """A new file starts at each cut position inside the document."""
    points = sorted({int(c) for c in cuts if int(c) > 0})
    if not points:
        return pages.withColumn("file_no", F.lit(0).cast("bigint"))
    passed = F.filter(F.array(*[F.lit(c) for c in points]), lambda c: c <= F.col("pos"))
    return pages.withColumn("file_no", F.size(passed).cast("bigint"))


def split_bookmarks(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """A new file at each bookmarked page except the first one (``starts``: doc_id, pos)."""
    inside = starts.select("doc_id", "pos").distinct().join(
        pages.select("doc_id", "pos"), ["doc_id", "pos"], "left_semi"
    )
    nth = number_rows(inside, ["doc_id"], "pos", out="_b").filter("_b > 1")
    marked = pages.join(nth, ["doc_id", "pos"], "left")
    flag = F.col("_b").isNotNull().cast("bigint")
    return running_sums(marked, ["doc_id"], "pos", {"file_no": flag}).drop("_b")


def split_points(text: str) -> tuple[list[int], list[str]]:
    """Cut positions from user text, and the pieces that are not numbers."""
    good, bad = [], []
    for piece in text.replace(",", " ").split():
        body = piece[1:] if piece[:1] in "+-" else piece
        (good if body.isascii() and body.isdigit() else bad).append(piece)
    return [int(p) for p in good], bad


def compose_split(files: DataFrame, title: str = "title") -> DataFrame:
    """File names of the parts of each document: padded number, or the title made unique.

    ``files``: one row per part (doc_id, file_no, title or NULL, n_files).
    """
    width = F.greatest(F.lit(2), F.length(F.col("n_files").cast("string")))
    plain = F.concat(F.lit("part_"), pad_number(F.col("file_no") + 1, width))
    stem = F.coalesce(F.when(F.trim(title) != "", F.trim(title)), plain)
    keyed = files.withColumn("_stem", F.concat(F.col("doc_id").cast("string"), F.lit("/"), stem))
    named = unique_names(keyed, "_stem", "file_no", "_u", fmt="-n", ignore_case=True)
    short = F.regexp_replace("_u", "^[^/]*/", "")
    return named.withColumn("file_name", F.concat(short, F.lit(".pdf"))).drop("_stem", "_u")


def reorder_pages(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Apply an order table (doc_id, page_key, new_pos) where it is an exact permutation.

    A document whose order misses, repeats or invents a page, or a position, keeps its order;
    ``applied`` says.
    """
    j = pages.select("doc_id", "page_key").join(
        order.withColumn("_o", F.lit(1)), ["doc_id", "page_key"], "full"
    )
    have = pages.select("doc_id", "page_key", F.lit(1).alias("_h"))
    j = j.join(have, ["doc_id", "page_key"], "left")
    n = F.count(F.lit(1))
    ok = j.groupBy("doc_id").agg(
        (
            (F.count_if(F.col("_o").isNull()) == 0)
            & (F.count_if(F.col("_h").isNull()) == 0)
            & (F.min("new_pos") == 0) & (F.max("new_pos") == n - 1)
            & (F.count_distinct("new_pos") == n) & (F.count_distinct("page_key") == n)
        ).alias("applied")
    )
    one = order.groupBy("doc_id", "page_key").agg(F.min("new_pos").alias("new_pos"))
    joined = pages.join(one, ["doc_id", "page_key"], "left").join(ok, "doc_id", "left")
    applied = F.coalesce(F.col("applied"), F.lit(False))
    return joined.select(
        *[c for c in pages.columns if c != "pos"],
        F.when(applied, F.col("new_pos")).otherwise(F.col("pos")).cast("bigint").alias("pos"),
        applied.alias("applied"),
    )


def move_pages(pages: DataFrame, selected: DataFrame, gap: int) -> DataFrame:
    """Selected pages (doc_id, page_key) move as a block to gap ``gap``; the rest keep order."""
    m = pages.join(selected.select("doc_id", "page_key", F.lit(1).alias("_sel")), ["doc_id", "page_key"], "left")
    sel = F.col("_sel").isNotNull()
    # before the gap, the block, after the gap; inside each the old order
    zone = F.when(sel, 1).when(F.col("pos") < gap, 0).otherwise(2)
    wide = m.withColumn("_key", zone * F.lit(1 << 40) + F.col("pos")).drop("_sel")
    return _renumber_zones(wide)


def _renumber_zones(wide: DataFrame) -> DataFrame:
    """Positions from a composite key zone·2^40 + order: counted per zone, zones stacked."""
    z = F.shiftright("_key", 40)
    zoned = wide.withColumns({"_z": z, "_in": F.col("_key").bitwiseAND(F.lit((1 << 40) - 1))}).drop("pos")
    per = number_rows(zoned, ["doc_id", "_z"], "_in", out="_rn")
    sizes = zoned.groupBy("doc_id", "_z").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("doc_id").orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("doc_id", "_z", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return per.join(base, ["doc_id", "_z"]).withColumn(
        "pos", F.col("_base") + F.col("_rn") - 1
    ).drop("_z", "_in", "_rn", "_base", "_key")


def duplicate_pages(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """A copy with a fresh key right after each selected page; the key is a hash, so a rerun
    of a lost task gives the same key."""
    m = pages.join(selected.select("doc_id", "page_key", F.lit(1).alias("_sel")), ["doc_id", "page_key"], "left")
    twice = F.when(F.col("_sel").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    copies = m.withColumn("_copy", F.explode(twice)).drop("_sel")
    key = F.when(F.col("_copy") == 0, F.col("page_key")).otherwise(
        F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "page_key", F.lit("copy")))
    )
    ordered = copies.withColumns({"page_key": key, "_ord": F.col("pos") * 2 + F.col("_copy")})
    return renumber(ordered.drop("_copy"), "_ord")


def default_front_count(pages: DataFrame) -> DataFrame:
    """Per document: where the second of two source runs starts, else half, rounded up."""
    g = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source_id").alias("_srcs"),
        F.min_by("source_id", "pos").alias("_first"),
    )
    runs = pages.join(g.select("doc_id", F.col("_first")), "doc_id").groupBy("doc_id").agg(
        F.count_if(F.col("source_id") == F.col("_first")).alias("_n1"),
        F.max(F.when(F.col("source_id") == F.col("_first"), F.col("pos"))).alias("_last1"),
    )
    two = (F.col("_srcs") == 2) & (F.col("_last1") + 1 == F.col("_n1"))
    return g.join(runs, "doc_id").select(
        "doc_id", "n", F.when(two, F.col("_n1")).otherwise(F.ceil(F.col("n") / 2)).alias("front_count")
    )


def interleave_duplex(pages: DataFrame, counts: DataFrame, backs_reversed: bool) -> DataFrame:
    """F1 B1 F2 B2 …; surplus pages stay at the end. ``counts``: doc_id, n, front_count."""
    j = pages.join(counts.select("doc_id", F.col("n").alias("_n"), F.col("front_count").alias("_f")), "doc_id")
    front = F.col("pos") < F.col("_f")
    back_i = F.col("_n") - 1 - F.col("pos") if backs_reversed else F.col("pos") - F.col("_f")
    i = F.when(front, F.col("pos")).otherwise(back_i)
    pairs = F.least(F.col("_f"), F.col("_n") - F.col("_f"))
    paired = i * 2 + F.when(front, 0).otherwise(1)
    new = F.when(i < pairs, paired).otherwise(pairs * 2 + i - pairs)
    return j.select(*[c for c in pages.columns if c != "pos"], new.cast("bigint").alias("pos"))


def duplex_fit(counts: DataFrame) -> DataFrame:
    diff = F.col("front_count") * 2 - F.col("n")
    fit = F.when(diff == 0, "exact").when(diff == 1, "last-front-alone").otherwise("mismatch")
    return counts.select("doc_id", fit.alias("fit"), F.abs(diff).alias("unpaired"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def booklet_place(pos: Column, n: Column) -> tuple[Column, Column]:
    """(slot, padded count) of a page in booklet order: slots 2i and 2i+1 are one sheet side."""
    total = (F.ceil(n / 4) * 4).cast("bigint")
    low = pos < total / 2
    i = F.when(low, pos).otherwise(total - 1 - pos)
    # even sides hold (last, first), odd sides (first, last)
    right = F.when(low, i % 2 == 0).otherwise(i % 2 == 1)
    return i * 2 + right.cast("int"), total


def nup(pages: DataFrame, layout: str, width: float, height: float, margin: float, gutter: float) -> DataFrame:
    """Sheet, row, column and cell box of every page: booklet, 2-up or 4-up.

    ``width`` × ``height`` is the landscape sheet (long side first).
    """
    rows = 2 if layout == "4-up" else 1
    sheet_w, sheet_h = (height, width) if layout == "4-up" else (width, height)
    cell_w = (sheet_w - margin * 2 - gutter) / 2
    cell_h = (sheet_h - margin * 2 - gutter * (rows - 1)) / rows
    j = pages.join(page_counts(pages), "doc_id")
    slot = booklet_place(F.col("pos"), F.col("n"))[0] if layout == "booklet" else F.col("pos")
    per = 2 * rows
    r, c = F.floor((slot % per) / 2), slot % 2
    return j.select(
        *pages.columns,
        F.floor(slot / per).alias("sheet"),
        r.alias("row"),
        c.cast("bigint").alias("col"),
        (F.lit(margin) + c * (cell_w + gutter)).alias("x"),
        (F.lit(sheet_h - margin) - r * (cell_h + gutter) - cell_h).alias("y"),
        F.lit(cell_w).alias("cell_w"),
        F.lit(cell_h).alias("cell_h"),
    )


def keyboard_move_target(selected: DataFrame, counts: DataFrame, direction: str, columns: int) -> DataFrame:
    """New gap for a selection moved by one step; NULL where nothing moves.

    ``selected``: doc_id, pos. The gap follows from the start of the block among the unselected
    pages: the start plus the selected pages in front of that gap.
    """
    step = 1 if direction in ("left", "right") else max(1, columns)
    delta = -step if direction in ("left", "up") else step
    sel = number_rows(selected.distinct(), ["doc_id"], "pos", out="_i")
    agg = sel.groupBy("doc_id").agg(
        F.min("pos").alias("_min"), F.max("pos").alias("_max"), F.count(F.lit(1)).alias("_k")
    ).join(counts, "doc_id")
    start = F.greatest(F.lit(0), F.least(F.col("n") - F.col("_k"), F.col("_min") + delta))
    agg = agg.withColumn("_start", start)
    # a selected page at pos is passed when fewer than start unselected pages lie before it
    passed = sel.join(agg.select("doc_id", "_start"), "doc_id").filter(
        F.col("pos") - (F.col("_i") - 1) < F.col("_start")
    ).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_passed"))
    still = (F.col("_max") - F.col("_min") + 1 == F.col("_k")) & (F.col("_start") == F.col("_min"))
    gap = F.col("_start") + F.coalesce(F.col("_passed"), F.lit(0))
    return agg.join(passed, "doc_id", "left").select(
        "doc_id", F.when(~still, gap).cast("bigint").alias("gap")
    )


def rotate_pages(pages: DataFrame, selected: DataFrame, delta: int) -> DataFrame:
    m = pages.join(selected.select("doc_id", "page_key", F.lit(1).alias("_sel")), ["doc_id", "page_key"], "left")
    turned = normalize_rotation(F.col("rotation") + F.when(F.col("_sel").isNotNull(), delta).otherwise(0))
    return m.select(*[c for c in pages.columns if c != "rotation"], turned.alias("rotation"))


def insert_pages(pages: DataFrame, extra: DataFrame, at: int) -> DataFrame:
    """Pages of ``extra`` (same columns) spliced in at a position, clamped to the document."""
    ours = pages.withColumn("_key", F.when(F.col("pos") < at, 0).otherwise(2) * F.lit(1 << 40) + F.col("pos"))
    new = extra.withColumn("_key", F.lit(1 << 40) + F.col("pos"))
    return _renumber_zones(ours.unionByName(new))


def delete_pages(pages: DataFrame, selected: DataFrame) -> DataFrame:
    """Drop selected pages, but never all pages of a document; positions close up.

    Adds ``kept_all`` for documents where the deletion was refused.
    """
    m = pages.join(selected.select("doc_id", "page_key", F.lit(1).alias("_sel")), ["doc_id", "page_key"], "left")
    refused = m.groupBy("doc_id").agg((F.count(F.lit(1)) == F.count("_sel")).alias("kept_all"))
    j = m.join(refused, "doc_id").filter(F.col("_sel").isNull() | F.col("kept_all")).drop("_sel")
    return renumber(j.withColumn("_ord", F.col("pos")), "_ord")


def select_between(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """All pages between two keys of each document (``ends``: doc_id, page_key), either order."""
    e = pages.join(ends.select("doc_id", "page_key"), ["doc_id", "page_key"], "left_semi")
    span = e.groupBy("doc_id").agg(F.min("pos").alias("_a"), F.max("pos").alias("_b"))
    return pages.join(span, "doc_id").filter(F.col("pos").between(F.col("_a"), F.col("_b"))).select(*pages.columns)
