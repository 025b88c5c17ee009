"""Histograms, correlation and overlap of boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.operators.ordered import keep_parallel, top_per_key


def histogram(df: DataFrame, keys: list[str], value: Column, bins: int = 256) -> DataFrame:
    """Count per key and bin; at most ``bins`` rows per key."""
    b = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(hist: DataFrame, keys: list[str]) -> DataFrame:
    """The bin that splits a histogram with the largest variance between the classes.

    Windows run over at most 256 rows per key. Ties go to the lowest bin; one bin alone is 128.
    """
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = hist.withColumns({
        "_below": F.sum("n").over(w), "_total": F.sum("n").over(whole),
        "_sb": F.sum(F.col("bin") * F.col("n")).over(w), "_sum": F.sum(F.col("bin") * F.col("n")).over(whole),
    })
    above = F.col("_total") - F.col("_below")
    gap = F.col("_sb") / F.col("_below") - (F.col("_sum") - F.col("_sb")) / above
    variance = F.when(above > 0, F.col("_below").cast("double") * above * gap * gap)
    scored = h.withColumn("_v", variance)
    return scored.groupBy(*keys).agg(
        F.coalesce(F.max_by("bin", F.when(F.col("_v").isNotNull(), F.struct("_v", (-F.col("bin")).alias("b")))), F.lit(128)).alias("threshold")
    )


def ink_coverage(hist: DataFrame, keys: list[str], cutoff: int = 250) -> DataFrame:
    dark = F.sum(F.when(F.col("bin") < cutoff, F.col("n")).otherwise(0))
    return hist.groupBy(*keys).agg((dark / F.sum("n")).alias("coverage"))


def changed_fraction(a: Column, b: Column, sensitivity: float, top: float) -> tuple[Column, Column]:
    """Share of samples that differ by more than the allowed part, and whether the pair changed."""
    limit = (100 - sensitivity) / 100 * top
    marks = F.zip_with(a, b, lambda x, y: F.coalesce((F.abs(x - y) > limit).cast("int"), F.lit(0)))
    n = F.aggregate(marks, F.lit(0), lambda s, m: s + m)
    share = F.when(F.size(a) > 0, n / F.size(a))
    changed = a.isNull() | b.isNull() | F.coalesce(F.size(a) != F.size(b), F.lit(True)) | F.coalesce(n > 0, F.lit(False))
    return share, changed


def correlation(field: Column, template: Column) -> Column:
    """Zero-mean normalised cross-correlation of two equal-length vectors; constant → 0."""
    n = F.size(field)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    f, t = F.transform(field, lambda v: v.cast("double")), F.transform(template, lambda v: v.cast("double"))
    mf, mt = total(f) / n, total(t) / n
    cross = total(F.zip_with(f, t, lambda x, y: x * y)) - mf * mt * n
    vf = total(F.transform(f, lambda v: v * v)) - mf * mf * n
    vt = total(F.transform(t, lambda v: v * v)) - mt * mt * n
    return F.when((vf <= 1e-6) | (vt <= 1e-6), F.lit(0.0)).otherwise(cross / F.sqrt(vf * vt))


def correlate_vectors(
    field: DataFrame, templates: DataFrame, on: str, min_score: float = 0.75, top: int | None = None
) -> DataFrame:
    """Best vectors per template. ``field``: vec_id, vec, ``on``; ``templates``: ``on``, template_id, template.

    Vectors meet only the templates of their own class, by an equi-join; with ``top``, the best of
    each template are found in two steps, so a template with most of the vectors is no hot spot.
    """
    scored = field.join(templates, on).withColumn("score", correlation(F.col("vec"), F.col("template")))
    good = scored.filter(F.col("score") >= min_score).select("template_id", "vec_id", "score")
    return good if top is None else top_per_key(good, ["template_id"], [F.desc("score"), F.col("vec_id")], top, "vec_id")


def suppress_overlaps(regions: DataFrame, iou: float = 0.3, limit: int | None = None) -> DataFrame:
    """Greedy choice per page: best score first, dropping what overlaps a chosen box.

    ``regions``: doc_id, page_no, region_no, x, y, width, height, score. Rows stream through in
    (page, score) order; the state is the chosen boxes of the current page, at most ``limit`` if given.
    """
    cols = ["doc_id", "page_no", "region_no", "x", "y", "width", "height", "score"]
    ordered = keep_parallel(regions.select(*cols), "doc_id", "page_no").sortWithinPartitions(
        "doc_id", "page_no", F.desc("score"), "region_no"
    )

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, chosen = None, []
        for pdf in batches:
            keep = []
            for row in pdf.itertuples(index=False):
                if (row.doc_id, row.page_no) != page:
                    page, chosen = (row.doc_id, row.page_no), []
                free = limit is None or len(chosen) < limit
                for x, y, w, h in chosen if free else ():
                    ox = min(x + w, row.x + row.width) - max(x, row.x)
                    oy = min(y + h, row.y + row.height) - max(y, row.y)
                    if ox > 0 and oy > 0:
                        both = ox * oy
                        if both / (w * h + row.width * row.height - both) > iou:
                            free = False
                            break
                if free:
                    chosen.append((row.x, row.y, row.width, row.height))
                keep.append(free)
            yield pdf[keep]

    return ordered.mapInPandas(pick, ordered.schema)
