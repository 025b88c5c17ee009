"""Comparing and combining page lists: alignment, set operations, marks, references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.text import trim_space
from corpuskit.operators.ordered import BLOCK, number_rows, running_sums
from corpuskit.session import cut_lineage

PAGE_COLS = ["page_key", "source_id", "source_index", "rotation"]


def _outside_longest_run(values: list[int]) -> list[bool]:
    """Which members of a sequence are outside one longest strictly increasing subsequence."""
    from bisect import bisect_left

    tails: list[int] = []
    tail_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = v, i
    outside = [True] * len(values)
    at = tail_at[-1] if tail_at else -1
    while at != -1:
        outside[at] = False
        at = before[at]
    return outside


def moved_pages(matched: DataFrame) -> DataFrame:
    """Add ``moved``: pages outside a longest increasing run of old positions.

    ``matched``: doc_id, pos, before_pos. A page with only smaller ones before it and only larger
    ones after it belongs to every longest run; such pages never reach Python and cut a document
    into stretches that are independent of each other. The kernel sees one stretch at a time, so
    its group is as long as one tangle, not as one document.
    """
    blk = F.floor(F.col("pos") / BLOCK)
    base = matched.withColumn("_blk", blk)
    inside = Window.partitionBy("doc_id", "_blk").orderBy("pos")
    up = inside.rowsBetween(Window.unboundedPreceding, -1)
    down = inside.rowsBetween(1, Window.unboundedFollowing)
    local = base.withColumns(
        {"_hi": F.max("before_pos").over(up), "_lo": F.min("before_pos").over(down)}
    )
    per = base.groupBy("doc_id", "_blk").agg(F.max("before_pos").alias("_m"), F.min("before_pos").alias("_n"))
    kw = Window.partitionBy("doc_id").orderBy("_blk")
    edges = per.select(
        "doc_id", "_blk",
        F.max("_m").over(kw.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi0"),
        F.min("_n").over(kw.rowsBetween(1, Window.unboundedFollowing)).alias("_lo0"),
    )
    j = local.join(edges, ["doc_id", "_blk"])
    hi, lo = F.greatest("_hi", "_hi0"), F.least("_lo", "_lo0")
    # a page with all smaller ones before it and all larger ones after it is in every longest run
    settled = F.coalesce(hi < F.col("before_pos"), F.lit(True)) & F.coalesce(
        lo > F.col("before_pos"), F.lit(True)
    )
    judged = j.withColumn("_settled", settled).select(*matched.columns, "_settled")
    quiet = judged.filter("_settled").select(*matched.columns, F.lit(False).alias("moved"))

    @F.pandas_udf("array<boolean>")
    def outside(stretches: pd.Series) -> pd.Series:
        return stretches.map(lambda v: _outside_longest_run(list(v)))

    # settled pages cut a document into stretches that do not influence each other; each is one
    # array, so a batch holds many of them
    stretch = running_sums(judged, ["doc_id"], "pos", {"_stretch": F.col("_settled").cast("bigint")})
    rest = [c for c in matched.columns if c not in ("doc_id", "pos")]
    busy = stretch.filter(~F.col("_settled")).groupBy("doc_id", "_stretch").agg(
        F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("_pages")
    )
    flagged = busy.select("doc_id", "_pages", outside(F.transform("_pages", lambda x: x["before_pos"])).alias("_out"))
    out = flagged.select("doc_id", F.explode(F.arrays_zip("_pages", "_out")).alias("_x")).select(
        "doc_id", "_x._pages.*", F.col("_x._out").alias("moved")
    )
    return quiet.unionByName(out)


def align_pages(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Every page as kept, added or removed, with rotated and moved flags."""
    b = baseline.select("doc_id", "page_key", F.col("pos").alias("before_pos"), F.col("rotation").alias("_br"))
    c = current.select("doc_id", "page_key", "pos", F.col("rotation").alias("after_rotation"))
    j = c.join(b, ["doc_id", "page_key"], "full")
    status = F.when(F.col("pos").isNull(), "removed").when(F.col("before_pos").isNull(), "added").otherwise("kept")
    rotated = F.coalesce(F.col("_br") != F.col("after_rotation"), F.lit(False))
    wide = j.select(
        "doc_id", "page_key", "before_pos", "pos", status.alias("status"), rotated.alias("rotated"), "after_rotation"
    )
    wide = cut_lineage(wide)
    kept = wide.filter("status = 'kept'").select("doc_id", "pos", "before_pos")
    moved = moved_pages(kept).select("doc_id", "pos", "moved")
    return wide.join(moved, ["doc_id", "pos"], "left").withColumn(
        "moved", F.coalesce("moved", F.lit(False))
    )


def removed_pages(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return baseline.join(current.select("doc_id", "page_key"), ["doc_id", "page_key"], "left_anti")


def added_pages(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return removed_pages(current, baseline)


def surviving_pages(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return baseline.join(current.select("doc_id", "page_key"), ["doc_id", "page_key"], "left_semi")


def merge_documents(parts: list[DataFrame], target: Column) -> DataFrame:
    """Ordered union of page lists into one document per ``target`` value."""
    from corpuskit.operators.sequence import _renumber_zones

    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_key", F.lit(i) * F.lit(1 << 40) + F.col("pos")).withColumn("doc_id", target)
        out = tagged if out is None else out.unionByName(tagged)
    return _renumber_zones(out)


def is_dirty(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per document: does any position differ in page, rotation or crop?"""
    cols = [c for c in ("page_key", "rotation", "crop", "annotations") if c in current.columns]
    b = baseline.select("doc_id", "pos", F.struct(*cols).alias("_b"))
    c = current.select("doc_id", "pos", F.struct(*cols).alias("_c"))
    j = b.join(c, ["doc_id", "pos"], "full")
    return j.groupBy("doc_id").agg(F.bool_or(~F.col("_b").eqNullSafe(F.col("_c"))).alias("dirty"))


def revert(baseline: DataFrame, current_annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The baseline pages, and no annotations."""
    return baseline, current_annotations.limit(0)


MARK_COLS = ["page_key", "x", "y", "width", "height", "text"]


def merge_marks(current: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All current marks plus the incoming ones not there yet (NULLs count as equal).

    ``added`` tells the new ones. Doubled incoming marks come in once.
    """
    keys = keys or [c for c in MARK_COLS if c in current.columns]
    new = incoming.dropDuplicates(keys)
    a, b = new.alias("a"), current.select(*keys).distinct().alias("b")
    on = None
    for k in keys:
        e = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = e if on is None else on & e
    fresh = a.join(b, on, "left_anti").withColumn("added", F.lit(True))
    return current.withColumn("added", F.lit(False)).unionByName(fresh)


def resolve_marks(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """A mark follows its page; deleted or turned pages withdraw it. Adds ``state``."""
    p = pages.select("doc_id", "page_key", F.col("pos").alias("_pos"), F.col("rotation").alias("_rot"))
    j = marks.join(p, ["doc_id", "page_key"], "left")
    state = (
        F.when(F.col("_pos").isNull(), "deleted")
        .when(F.col("_rot") != F.col("page_rotation"), "rotated")
        .when(F.col("_pos") != F.col("page_no"), "moved")
        .otherwise("kept")
    )
    return j.select(
        *[c for c in marks.columns if c != "page_no"], F.coalesce("_pos", "page_no").alias("page_no"), state.alias("state")
    )


def referenced_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    return sources.join(pages.select("source_id"), "source_id", "left_semi")


def referenced_ids(*parts: DataFrame) -> DataFrame:
    """Source ids any of the page lists, snapshots or pending imports refers to."""
    out = None
    for p in parts:
        ids = p.select("source_id").distinct()
        out = ids if out is None else out.union(ids)
    return out.distinct()


def orphan_sources(sources: DataFrame, *parts: DataFrame) -> DataFrame:
    return sources.join(referenced_ids(*parts), "source_id", "left_anti")


def source_ref_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"))


def source_doc_ref_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_id").agg(F.count_distinct("doc_id").alias("docs"))


def stamp_all_pages(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """A copy of each annotation on every other page of its document, with a stable new id."""
    p = pages.select("doc_id", F.col("page_key").alias("_to"))
    j = annotations.join(p, "doc_id").filter(F.col("_to") != F.col("page_key"))
    new_id = F.md5(F.concat_ws("|", F.col("ann_id").cast("string"), "_to"))
    return j.withColumns({"ann_id": new_id, "page_key": F.col("_to")}).drop("_to")


def annotation_pages(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Page number of each annotation: its own index, else that of its page key, else NULL."""
    p = pages.select("doc_id", "page_key", F.col("pos").alias("_pos"))
    j = annotations.join(p, ["doc_id", "page_key"], "left")
    return j.select(*annotations.columns, F.coalesce("page_index", "_pos").alias("page_no"))


def place_highlights(regions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Highlights as horizontal strokes on their page, and a count of regions without a page.

    ``regions``: doc_id, page_no, x, y, width, height; ``pages``: doc_id, pos, page_key, aspect.
    """
    p = pages.select("doc_id", F.col("pos").alias("page_no"), "page_key", "aspect")
    aspect = F.when((F.col("aspect") > 0) & (F.col("aspect") < float("inf")), F.col("aspect")).otherwise(1.0)
    mid = F.col("y") + F.col("height") / 2
    placed = regions.join(p, ["doc_id", "page_no"]).select(
        *regions.columns, "page_key",
        F.greatest(F.col("height") * aspect, F.lit(0.001)).alias("stroke_width"),
        F.array(
            F.struct(F.col("x").alias("x"), mid.alias("y")),
            F.struct((F.col("x") + F.col("width")).alias("x"), mid.alias("y")),
        ).alias("points"),
    )
    lost = regions.join(p, ["doc_id", "page_no"], "left_anti").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("unplaced")
    )
    return placed, lost


def resolve_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Page number per bookmark, −1 where its page is gone; blank titles become ``Untitled``."""
    p = pages.select("doc_id", "page_key", F.col("pos").alias("_pos"))
    j = outline.join(p, ["doc_id", "page_key"], "left")
    title = F.when(trim_space(F.col("title")) == "", F.lit("Untitled")).otherwise(trim_space(F.col("title")))
    return j.select(
        *[c for c in outline.columns if c != "title"], title.alias("title"),
        F.coalesce("_pos", F.lit(-1)).cast("bigint").alias("page_no"),
    )


def bookmark_slices(resolved: DataFrame) -> DataFrame:
    """Top-level bookmarks with a page; the first title of a page wins."""
    top = resolved.filter((F.col("depth") == 0) & (F.col("page_no") >= 0))
    return top.groupBy("doc_id", "page_no").agg(F.min_by("title", "node_no").alias("title"))


def flatten_outline(outline: DataFrame) -> DataFrame:
    """Depth-first rows with the moves each entry allows.

    ``outline``: doc_id, path ARRAY<INT> (sibling numbers from the root), title. Sorting by path
    is depth-first order. Siblings are those with the same path but for the last number.
    """
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    base = outline.withColumns({"_parent": F.to_json(parent), "_at": F.element_at("path", -1)})
    ends = base.groupBy("doc_id", "_parent").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    j = base.join(ends, ["doc_id", "_parent"])
    depth = F.size("path") - 1
    return j.select(
        *outline.columns, depth.cast("bigint").alias("depth"),
        (F.col("_at") > F.col("_lo")).alias("up"), (F.col("_at") < F.col("_hi")).alias("down"),
        (F.col("_at") > F.col("_lo")).alias("indent"), (depth > 0).alias("outdent"),
    )


def edit_outline(outline: DataFrame, op: str, node_no: int, value: str | None = None) -> DataFrame:
    """One edit on the bookmark with number ``node_no`` of each document.

    ``outline``: doc_id, node_no, path, title, page_key. rename / page set a value; delete drops
    the subtree; up / down swap with a sibling; indent goes under the previous sibling as its
    last child; outdent goes right after the parent. Paths stay sibling numbers; they may have
    gaps, as only their order counts.
    """
    node = outline.filter(F.col("node_no") == node_no).select("doc_id", F.col("path").alias("_p"))
    j = outline.join(node, "doc_id", "left")
    p, path = F.col("_p"), F.col("path")
    depth = F.size(p)
    in_tree = F.coalesce(F.slice(path, F.lit(1), F.greatest(depth, F.lit(1))) == p, F.lit(False))
    if op in ("rename", "page"):
        col = "title" if op == "rename" else "page_key"
        return j.withColumn(
            col, F.when(F.col("node_no") == node_no, F.lit(value)).otherwise(F.col(col))
        ).select(*outline.columns)
    if op == "delete":
        return j.filter(~in_tree).select(*outline.columns)

    parent = F.slice(p, F.lit(1), F.greatest(depth - 1, F.lit(0)))
    at = F.element_at(p, -1)
    sibling = (F.size(path) == depth) & (F.slice(path, F.lit(1), F.greatest(depth - 1, F.lit(0))) == parent)
    other_at = F.element_at("path", -1)
    before = j.filter(sibling & (other_at < at)).groupBy("doc_id").agg(F.max(other_at).alias("_prev"))
    after = j.filter(sibling & (other_at > at)).groupBy("doc_id").agg(F.min(other_at).alias("_next"))
    j = j.join(before, "doc_id", "left").join(after, "doc_id", "left")

    def head(path_col: Column, with_last: Column) -> Column:
        rest = F.slice(path_col, depth + 1, F.size(path_col))
        return F.concat(parent, F.array(with_last.cast("int")), rest)

    in_family = F.slice(path, F.lit(1), F.greatest(depth - 1, F.lit(0))) == parent
    place = F.try_element_at(path, F.greatest(depth, F.lit(1)))
    if op in ("up", "down"):
        target = F.col("_prev") if op == "up" else F.col("_next")
        new = (
            F.when(target.isNull() | ~in_family | (F.size(path) < depth), path)
            .when(place == at, head(path, target))
            .when(place == target, head(path, at))
            .otherwise(path)
        )
    elif op == "indent":
        kids = j.filter(
            in_family & (F.size(path) == depth + 1) & (place == F.col("_prev"))
        ).groupBy("doc_id").agg(F.max(F.element_at("path", -1)).alias("_kid"))
        j = j.join(kids, "doc_id", "left")
        under = F.concat(
            parent, F.array(F.col("_prev"), (F.coalesce("_kid", F.lit(-1)) + 1)),
            F.slice(path, depth + 1, F.size(path)),
        )
        new = F.when(in_tree & F.col("_prev").isNotNull(), under).otherwise(path)
    elif op == "outdent":
        # doubled numbers leave room right after the parent without touching other rows' order
        twice = F.transform(path, lambda x: x * 2)
        up = F.concat(
            F.transform(F.slice(p, F.lit(1), F.greatest(depth - 2, F.lit(0))), lambda x: x * 2),
            F.array(F.try_element_at(p, F.greatest(depth - 1, F.lit(1))) * 2 + 1),
            F.transform(F.slice(path, depth + 1, F.size(path)), lambda x: x * 2),
        )
        new = F.when(in_tree & (depth > 1), up).otherwise(twice)
    else:
        raise ValueError(f"unknown outline edit {op}")
    return j.withColumn("path", new).select(*outline.columns)


def append_entries(outline: DataFrame, entries: DataFrame) -> DataFrame:
    """New top-level bookmarks (doc_id, node_no, title, page_key) after the existing ones."""
    last = outline.groupBy("doc_id").agg(F.max(F.col("path")[0]).alias("_last"))
    nth = number_rows(entries, ["doc_id"], "node_no", out="_rn")
    new = nth.join(last, "doc_id", "left").withColumn(
        "path", F.array((F.coalesce("_last", F.lit(-1)) + F.col("_rn")).cast("int"))
    )
    return outline.unionByName(new.select(*outline.columns))
