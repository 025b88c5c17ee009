"""Size planning over image facts and byte sizes.

``images``: doc_id, page_no, image_no, name, object_no (−1 = not shared), width, height, bits,
color_space, filters, mask_filters, mask_kind, is_mask, byte_length, placed_w, placed_h, and
flate_bytes (size of raw samples after lossless packing, NULL if not raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.geometry import (
    MIN_DOWNSCALE_RATIO,
    effective_dpi,
    projected_bytes,
    target_pixels,
)
from corpuskit.functions.names import js_round
from corpuskit.operators.ordered import counted_join, running_sums

# Filters no decoder output may be re-encoded from, and named-ink colour spaces.
UNDECODABLE = ["JPXDecode", "JBIG2Decode"]
UNSAFE_SPACES = ["DeviceN", "Separation"]
LOSSLESS_MAX_KEPT = 0.9
_PAGE = ["doc_id", "page_no"]
# The ladder of settings, best first (dpi, quality).
LADDER = [
    (300, 0.9), (300, 0.75), (200, 0.75), (150, 0.75), (150, 0.6),
    (110, 0.6), (110, 0.45), (72, 0.45), (72, 0.3),
]


def image_safety(images: DataFrame) -> DataFrame:
    """Add surgical, raster and reason: what may be done with an image."""
    none = F.array().cast("array<string>")
    bad = F.array(*[F.lit(x) for x in UNDECODABLE])
    hit = F.array_intersect(F.coalesce("filters", none), bad)
    mask_hit = F.array_intersect(F.coalesce("mask_filters", none), bad)
    blocked = (
        F.when(F.col("color_space").isin(UNSAFE_SPACES), F.concat(F.col("color_space"), F.lit(" image: named ink")))
        .when(F.col("is_mask"), F.lit("stencil mask"))
        .when(F.col("mask_kind") == "colorKey", F.lit("colour-key mask"))
        .when(F.col("mask_kind") == "preblended", F.lit("pre-blended mask"))
    )
    limited = (
        F.when(F.size(hit) > 0, F.concat(hit[0], F.lit(" image: not decodable")))
        .when(F.size(mask_hit) > 0, F.concat(mask_hit[0], F.lit(" mask: not decodable")))
        .when(F.col("bits") < 8, F.concat(F.col("bits").cast("string"), F.lit("-bit image")))
    )
    return images.withColumns({
        "raster": blocked.isNull(),
        "surgical": blocked.isNull() & limited.isNull(),
        "reason": F.coalesce(blocked, limited),
    })


def object_safety(safe: DataFrame) -> DataFrame:
    """Per shared object: safe only if every use is; the first blocking reason wins."""
    place = F.struct(F.col("raster").cast("int"), "page_no", "image_no")
    shared = safe.filter(F.col("object_no") >= 0)
    return shared.groupBy("doc_id", "object_no").agg(
        F.bool_and("surgical").alias("surgical"),
        F.bool_and("raster").alias("raster"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), place)).alias("reason"),
        F.count(F.lit(1)).alias("uses"),
    )


def with_object_safety(images: DataFrame) -> DataFrame:
    """Image verdicts with those of shared objects merged over all their uses."""
    own = image_safety(images)
    per = object_safety(own).select(
        "doc_id", "object_no", F.col("surgical").alias("_s"), F.col("raster").alias("_r"),
        F.col("reason").alias("_why"), "uses",
    )
    j = counted_join(own, per, ["doc_id", "object_no"], "uses")
    return j.withColumns({
        "surgical": F.coalesce("_s", "surgical"), "raster": F.coalesce("_r", "raster"),
        "reason": F.when(F.col("_s").isNull(), F.col("reason")).otherwise(F.col("_why")),
    }).drop("_s", "_r", "_why")


def governing_use(images: DataFrame) -> DataFrame:
    """Per shared object the use with the lowest resolution on paper (``dpi`` given)."""
    use = F.struct("page_no", "image_no", "dpi", "pixels_wanted")
    return images.filter(F.col("object_no") >= 0).groupBy("doc_id", "object_no").agg(
        F.min_by(use, F.struct("dpi", "page_no", "image_no")).alias("use"), F.count(F.lit(1)).alias("uses")
    )


def count_once(images: DataFrame) -> DataFrame:
    """Uses whose bytes count: the first use of a shared object, and every unshared image."""
    shared = images.filter(F.col("object_no") >= 0)
    first = shared.groupBy("doc_id", "object_no").agg(
        F.min(F.struct("page_no", "image_no")).alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    kept = counted_join(shared, first, ["doc_id", "object_no"], "_n", "inner").filter(
        (F.col("page_no") == F.col("_first.page_no")) & (F.col("image_no") == F.col("_first.image_no"))
    ).select(*images.columns)
    return kept.unionByName(images.filter(F.col("object_no") < 0))


def largest_placement(images: DataFrame) -> DataFrame:
    """Per object the biggest shown area; a use without a measured placement beats all."""
    area = F.col("placed_w") * F.col("placed_h")
    rank = F.struct(area.isNull().cast("int").alias("u"), area.alias("a"), (-F.col("page_no")).alias("p"))
    return images.groupBy("doc_id", "object_no").agg(
        F.max_by(F.struct("page_no", "placed_w", "placed_h"), rank).alias("use")
    ).select("doc_id", "object_no", "use.*")


def attach_text_census(inventory: DataFrame, census: DataFrame) -> DataFrame:
    """Pages with their visible characters and runs; pages without a census count as 0, 0."""
    zero = F.lit(0).cast("bigint")
    c = census.select("doc_id", "page_no", F.col("char_count").alias("_c"), F.col("run_count").alias("_r"))
    return inventory.join(c, ["doc_id", "page_no"], "left").select(
        *inventory.columns, F.coalesce("_c", zero).alias("char_count"), F.coalesce("_r", zero).alias("run_count")
    )


def classify_pages(pages: DataFrame, images: DataFrame, census: DataFrame, dpi: int) -> DataFrame:
    """What to do with each page: raster, surgical, skip or already-optimized, with sizes.

    ``pages``: doc_id, page_no, page_width, page_height (all pages, also those without images). Pages, census
    and images are dealt by document once, as rows of one table; windows over its pages and shared
    objects carry facts from row to row, so there is no join and no second shuffle, and what follows per document needs none.
    """
    own = image_safety(images).select(
        *_PAGE, "image_no", "object_no", "width", "height", "placed_w", "placed_h", "byte_length", "flate_bytes", "surgical", "raster",
        F.lit(True).alias("_image"),
    )
    sheets = pages.select(*_PAGE, "page_width", "page_height", F.lit(True).alias("_page"))
    counts = census.select(*_PAGE, "char_count", "run_count")
    rows = own.unionByName(sheets, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True).repartition("doc_id")

    page, use = Window.partitionBy(*_PAGE), Window.partitionBy("doc_id", "object_no")
    zero = F.lit(0).cast("bigint")
    known = rows.withColumns({
        **{c: F.max(c).over(page) for c in ("page_width", "page_height", "_page")},
        **{c: F.coalesce(F.max(c).over(page), zero) for c in ("char_count", "run_count")},
    }).filter("_image OR _page")
    size = (F.col("width"), F.col("height"), F.col("placed_w"), F.col("placed_h"), F.col("page_width"), F.col("page_height"))
    has_text, shared = F.col("char_count") >= 1, F.col("object_no") >= 0
    uses = known.withColumns({"dpi": effective_dpi(*size), "pixels_wanted": target_pixels(*size, F.lit(dpi))})
    # an object is safe if every use is; its use of least resolution on pages with text governs it
    governs = F.when(F.col("_page") & has_text, F.struct("dpi", "page_no", "image_no", "pixels_wanted"))
    j = uses.withColumns({
        **{c: F.when(shared, F.bool_and(c).over(use)).otherwise(F.col(c)) for c in ("surgical", "raster")},
        "_gov": F.when(shared, F.min(governs).over(use)),
    }).filter("_page").withColumn("_gov", F.when(F.col("surgical"), F.col("_gov")))
    limit = dpi * MIN_DOWNSCALE_RATIO
    flate_ok = F.coalesce(F.col("flate_bytes") <= F.col("byte_length") * LOSSLESS_MAX_KEPT, F.lit(False))
    over = F.when(shared, F.coalesce(F.col("_gov.dpi") > limit, F.lit(False))).otherwise(F.col("dpi") > limit)
    lossless = shared & F.col("_gov.dpi").isNotNull() & ~over & flate_ok
    j = j.withColumns({
        "_lossless": lossless,
        "_cand": has_text & F.col("surgical") & (over | lossless),
        "_px": F.coalesce(F.when(shared, F.col("_gov.pixels_wanted")), F.col("pixels_wanted")),
    }).drop("_gov", "dpi", "pixels_wanted", "placed_w", "placed_h")
    flags = {
        "n_images": F.count("_image").over(page),
        "image_pixels": F.coalesce(F.sum(F.col("width") * F.col("height")).over(page), zero).cast("bigint"),
        "blocks_raster": F.coalesce(F.bool_or(~F.col("raster")).over(page), F.lit(False)),
        "n_unsafe": F.count_if(~F.col("surgical")).over(page),
        "n_candidates": F.count_if("_cand").over(page),
        "n_lossless": F.count_if(F.col("_cand") & F.col("_lossless")).over(page),
    }
    bare = (F.col("n_images") == 0) & ~has_text
    route = (
        F.when(~has_text & ((F.col("n_images") == 0) | F.col("blocks_raster")), "already-optimized")
        .when(~has_text, "raster")
        .when(F.col("n_candidates") > 0, "surgical")
        .when(F.col("n_unsafe") > 0, "skip")
        .otherwise("already-optimized")
    )
    reason = (
        F.when(bare & (F.col("run_count") > 0), "text only")
        .when(bare, "neither text nor images")
        .when(~has_text & F.col("blocks_raster"), "images that must not be rasterised")
        .when(~has_text, "scanned page")
        .when(F.col("n_candidates") > 0, F.format_string(
            "%d over-sampled, %d uncompressed", F.col("n_candidates") - F.col("n_lossless"), F.col("n_lossless")))
        .when(F.col("n_unsafe") > 0, F.format_string("%d images left untouched", F.col("n_unsafe")))
        .otherwise("at the target resolution")
    )
    is_surgical = route == "surgical"
    acts = F.col("_image") & ((route == "raster") | (is_surgical & F.col("_cand")))
    # of a shared object the first use that is acted on counts
    place = F.struct("page_no", "image_no")
    routed = j.withColumns(flags).withColumn("_acts", F.coalesce(acts, F.lit(False)))
    first = F.min(F.when(F.col("_acts"), place)).over(use)
    counted = routed.withColumn("_acts", F.col("_acts") & ((F.col("object_no") < 0) | (shared & (place == first))))
    own_way = F.col("_acts") & is_surgical
    per = counted.groupBy(*_PAGE).agg(
        *[F.max(c).alias(c) for c in ("page_width", "page_height", "char_count", "run_count", *flags)],
        F.sum(F.when(F.col("_acts"), F.col("byte_length"))).alias("actionable_bytes"),
        F.sum(F.when(own_way & ~F.col("_lossless"), F.col("_px"))).alias("_spx"),
        F.sum(F.when(own_way & F.col("_lossless"), F.col("byte_length"))).alias("lossless_bytes"),
        F.sum(F.when(own_way & F.col("_lossless"), F.least("byte_length", "flate_bytes"))).alias("lossless_projected"),
    ).withColumns({"route": route, "reason": reason})
    page_px = (
        F.greatest(F.lit(1), js_round(F.col("page_width") / 72 * dpi))
        * F.greatest(F.lit(1), js_round(F.col("page_height") / 72 * dpi))
    )
    return per.select(
        "doc_id", "page_no", "route", "reason", "image_pixels",
        F.coalesce("actionable_bytes", zero).cast("bigint").alias("actionable_bytes"),
        F.when(F.col("route") == "raster", page_px).otherwise(F.coalesce("_spx", zero)).cast("bigint").alias("target_pixels"),
        F.coalesce("lossless_bytes", zero).cast("bigint").alias("lossless_bytes"),
        F.coalesce("lossless_projected", zero).cast("bigint").alias("lossless_projected"),
    )


def estimate_savings(plan: DataFrame, totals: DataFrame, quality: float) -> DataFrame:
    """Expected bytes per document. ``totals``: doc_id, total_bytes."""
    s = plan.groupBy("doc_id").agg(
        F.sum("actionable_bytes").alias("_act"),
        F.sum("lossless_bytes").alias("_lb"),
        F.sum(F.least("lossless_bytes", "lossless_projected")).alias("_lp"),
        F.sum(projected_bytes(F.col("target_pixels"), F.lit(quality))).alias("_px"),
    )
    jpeg = F.greatest(F.lit(0), F.col("_act") - F.col("_lb"))
    kept = min(0.95, max(0.1, quality * 0.55))
    capped = F.least(F.col("_px"), jpeg * kept, jpeg.cast("double")) + F.col("_lp")
    rest = F.greatest(F.lit(0), F.col("total_bytes") - F.col("_act"))
    estimate = F.greatest(F.lit(1.0), rest + capped)
    return s.join(totals, "doc_id").select(
        "doc_id", js_round(estimate).cast("bigint").alias("estimated_bytes"),
        F.when(F.col("total_bytes") > 0, 1 - estimate / F.col("total_bytes")).otherwise(0.0).alias("estimated_fraction"),
    )


def refine_estimate(plan: DataFrame, totals: DataFrame, measured: DataFrame, quality: float) -> DataFrame:
    """Expected bytes rescaled from one measured page per document.

    ``measured``: doc_id, page_no, before_bytes, after_bytes, page_actionable, page_pixels.
    Documents whose measured page cannot serve as a yardstick give NULL. ``measured`` may bring the
    ``route`` of its page, which saves a join.
    """
    if "route" in measured.columns:
        m = measured.withColumnRenamed("route", "_route")
    else:
        m = measured.join(plan.select("doc_id", "page_no", F.col("route").alias("_route")), ["doc_id", "page_no"], "left")
    overhead = F.greatest(F.lit(0), F.col("before_bytes") - F.col("page_actionable"))
    after = F.col("after_bytes") - F.when(F.col("_route") == "surgical", overhead).otherwise(0)
    usable = F.col("_route").isin("raster", "surgical") & (F.col("page_pixels") > 0) & (after > 0)
    yard = m.select(
        "doc_id", "_route", F.when(usable, after / F.col("page_pixels")).alias("_per"),
        F.when(F.col("_route") == "raster", overhead / F.col("page_pixels")).otherwise(0.0).alias("_gone"),
    )
    j = plan.join(yard, "doc_id")
    same = F.col("route") == F.col("_route")
    px = F.col("target_pixels")
    picture = F.when(px <= 0, 0.0).when(same, F.col("_per") * px).otherwise(projected_bytes(px, F.lit(quality)))
    s = j.groupBy("doc_id").agg(
        F.sum(picture + F.least("lossless_bytes", "lossless_projected")).alias("_img"),
        F.sum(F.when(same & (px > 0), F.col("_gone") * px).otherwise(0.0)).alias("_vanish"),
        F.sum("actionable_bytes").alias("_act"), F.max("_per").alias("_ok"),
    ).join(totals, "doc_id")
    rest = F.greatest(F.lit(0.0), F.col("total_bytes") - F.col("_act") - F.col("_vanish"))
    estimate = F.least(F.col("total_bytes").cast("double"), F.greatest(F.lit(1.0), rest + F.col("_img")))
    good = F.col("_ok").isNotNull() & (F.col("_img") > 0)
    return s.select("doc_id", F.when(good, js_round(estimate)).cast("bigint").alias("estimated_bytes"))


def representative_page(plan: DataFrame, *more: str) -> DataFrame:
    """The page of each document with the most image pixels, and what else of it is asked for."""
    rank = F.struct("image_pixels", "actionable_bytes", (-F.col("page_no")).alias("p"))
    shown = F.struct("page_no", *more)
    return plan.groupBy("doc_id").agg(F.max(F.struct(rank.alias("rank"), shown.alias("shown"))).alias("_b")).select("doc_id", "_b.shown.*")


def size_report(stats: DataFrame) -> DataFrame:
    """Original, result, saved and percent per image, page, document and over all.

    ``stats``: doc_id, page_no, image_id, original_bytes, result_bytes.
    """
    r = stats.rollup("doc_id", "page_no", "image_id").agg(
        F.grouping_id().alias("gid"), F.sum("original_bytes").alias("original"), F.sum("result_bytes").alias("result")
    )
    level = F.element_at(
        F.create_map(*[F.lit(x) for kv in ((0, "image"), (1, "page"), (3, "document"), (7, "all")) for x in kv]),
        F.col("gid").cast("int"),
    )
    saved = F.greatest(F.lit(0), F.col("original") - F.col("result"))
    return r.select(
        "doc_id", "page_no", "image_id", level.alias("level"), "original", "result", saved.alias("saved"),
        F.when(F.col("original") > 0, F.round(saved / F.col("original") * 100, 2)).otherwise(0.0).alias("percent"),
        (F.col("result") >= F.col("original")).alias("kept"),
    )


def compression_report(stats: DataFrame) -> DataFrame:
    """The size report of each document as text, one line per page, total first."""
    per = size_report(stats).filter("level IN ('page', 'document')")
    line = F.when(
        F.col("level") == "document", F.format_string("Total: %d -> %d bytes (%.2f%%)", "original", "result", "percent")
    ).otherwise(F.format_string("Page %d: %d -> %d bytes (%.2f%%)", F.col("page_no") + 1, "original", "result", "percent"))
    order = F.coalesce("page_no", F.lit(-1))
    lines = per.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("_l"))
    return lines.select("doc_id", F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("report"))


def split_by_size(pages: DataFrame, target: int) -> DataFrame:
    """Ranges from halving each document until a range fits or is one page.

    ``pages``: doc_id, pos, n_bytes, n (pages of the document). The ranges a page can be in are
    known from ``n`` alone, so each page names all of them (at most log2 n) and one grouped sum
    gives every range's size; a range is final if it fits (or is one page) and its parent does
    not. No loop and no window; sums combine map-side, so a huge document is no hot spot.
    """
    root = F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").cast("bigint").alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        last = F.element_at(acc, -1)
        mid = last["a"] + F.floor((last["b"] - last["a"]) / 2)
        low = F.col("pos") < mid
        child = F.struct(
            F.when(low, last["a"]).otherwise(mid).alias("a"), F.when(low, mid).otherwise(last["b"]).alias("b")
        )
        return F.when(last["b"] - last["a"] > 1, F.concat(acc, F.array(child))).otherwise(acc)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(2)))).cast("int") + 1)
    chain = F.aggregate(steps, F.array(root), halve)
    links = F.transform(
        chain,
        lambda r, i: F.struct(r.alias("r"), F.when(i > 0, F.try_element_at(chain, F.greatest(i, F.lit(1)))).alias("parent")),
    )
    per = (
        pages.select("doc_id", "n_bytes", F.explode(links).alias("x"))
        .groupBy("doc_id", "x.r", "x.parent")
        .agg(F.sum("n_bytes").alias("bytes"))
    )
    big = per.filter(F.col("bytes") > target).select("doc_id", F.col("r").alias("parent"), F.lit(True).alias("_pbig"))
    small_enough = (F.col("bytes") <= target) | (F.col("r.b") - F.col("r.a") <= 1)
    j = per.filter(small_enough).join(big, ["doc_id", "parent"], "left")
    return j.filter(F.col("parent").isNull() | F.col("_pbig")).select(
        "doc_id", F.col("r.a").alias("from_pos"), F.col("r.b").alias("to_pos"), "bytes",
        (F.col("bytes") > target).alias("oversized"),
    )


def pick_setting(trials: DataFrame, target: int, rungs: int = len(LADDER)) -> DataFrame:
    """Best rung that fits, by the same search over measured sizes: last rung first, then halving.

    ``trials``: doc_id, rung (0 best), bytes. The sizes of one document are one short array.
    """
    sizes = trials.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("rung") == i, F.col("bytes"))).alias(f"_b{i}") for i in range(rungs)]
    ).select("doc_id", F.array(*[f"_b{i}" for i in range(rungs)]).alias("_b"))
    start = F.struct(F.lit(0).alias("lo"), F.lit(rungs - 2).alias("hi"), F.lit(rungs - 1).alias("best"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        go = acc["lo"] <= acc["hi"]
        fits = F.col("_b")[mid] <= target
        return F.struct(
            F.when(go & ~fits, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(go & fits, mid - 1).otherwise(acc["hi"]).alias("hi"),
            F.when(go & fits, mid).otherwise(acc["best"]).alias("best"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda a: a["best"])
    reached = F.col("_b")[rungs - 1] <= target
    rung = F.when(reached, found).otherwise(rungs - 1)
    return sizes.select("doc_id", reached.alias("reached"), rung.cast("bigint").alias("rung")).withColumn(
        "dpi", F.element_at(F.array(*[F.lit(d) for d, _ in LADDER]), (F.col("rung") + 1).cast("int")).cast("bigint")
    ).withColumn("quality", F.element_at(F.array(*[F.lit(q) for _, q in LADDER]), (F.col("rung") + 1).cast("int")))


def pick_quality(trials: DataFrame, target: Column, cap: Column) -> DataFrame:
    """Of measured trials (image_id, scale, quality, bytes) the one to keep.

    First choice full size under the cap, then full size under the target, then the largest
    scale under the target, each with the best quality; if none fits, the smallest.
    """
    full = F.col("scale") >= 1
    tier = (
        F.when(full & (F.col("bytes") <= F.least(target, cap)), 3)
        .when(full & (F.col("bytes") <= target), 2)
        .when(F.col("bytes") <= target, 1)
        .otherwise(0)
    )
    rank = F.struct(
        tier.alias("t"),
        F.when(tier == 0, -F.col("bytes")).otherwise(0).alias("small"),
        F.col("scale").alias("s"), F.col("quality").alias("q"),
    )
    best = trials.groupBy("image_id").agg(
        F.max_by(F.struct("scale", "quality", "bytes", (tier > 0).alias("reached")), rank).alias("b")
    )
    return best.select("image_id", "b.*")


def page_batches(pages: DataFrame, uses: DataFrame, per_batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """Consecutive batches of pages, and for each object the batch and page that ask for it first."""
    batched = pages.withColumn("batch", F.floor(F.col("pos") / max(1, per_batch)))
    first = uses.join(batched.select("doc_id", "pos", "batch"), ["doc_id", "pos"]).groupBy("doc_id", "object_no").agg(
        F.min("batch").alias("batch"), F.min("pos").alias("pos")
    )
    return batched, first


def workspace_capacity(files: DataFrame, max_count: int, soft_bytes: int) -> DataFrame:
    """Per workspace in order: may this file still open, and is the soft byte limit passed?"""
    run = running_sums(files, ["workspace"], "pos", {"open_count": F.lit(1).cast("bigint"), "open_bytes": F.col("bytes")})
    return run.withColumns({
        "ok": F.col("open_count") <= max_count,
        "over_soft": (F.col("open_count") <= max_count) & (F.col("bytes") > 0) & (F.col("open_bytes") > soft_bytes),
    })


def band_columns(widths: Column, max_columns: int, max_width: float) -> Column:
    """Band number of each column: a new band when the next one would not fit."""

    def step(acc: Column, w: Column) -> Column:
        new = (acc["k"] > 0) & ((acc["k"] >= max_columns) | (acc["w"] + w > max_width))
        band = acc["band"] + new.cast("int")
        return F.struct(
            F.when(new, 1).otherwise(acc["k"] + 1).alias("k"),
            F.when(new, w).otherwise(acc["w"] + w).alias("w"),
            band.alias("band"),
            F.concat(acc["out"], F.array(band)).alias("out"),
        )

    start = F.struct(
        F.lit(0).alias("k"), F.lit(0.0).alias("w"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("out")
    )
    return F.aggregate(widths, start, step, lambda a: a["out"])
