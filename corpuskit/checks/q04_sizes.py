"""Size planning, statistics and comparison."""

from pyspark.sql import functions as F

from corpuskit.checks import sqlparts as S
from corpuskit.checks.q02_text import pages_of
from corpuskit.checks.q03_sequences import dp
from corpuskit.checks.registry import register
from corpuskit.operators import compare as C
from corpuskit.operators import long_diff as LD
from corpuskit.operators import metadata as M
from corpuskit.operators import pages as PG
from corpuskit.operators import sizing as Z
from corpuskit.operators import stats as ST

W = f"WITH {S.DP} "

# every order line is an image: the order is the document, the line number the page
IMG = """img AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS page_no, (l_partkey * 1000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS image_no,
  CASE WHEN l_partkey % 5 = 0 THEN -1 ELSE l_partkey % 4 END AS object_no, CAST(l_quantity * 40 AS BIGINT) AS width, CAST(l_quantity * 30 AS BIGINT) AS height,
  CASE WHEN l_suppkey % 11 = 3 THEN 1 ELSE 8 END AS bits, CASE WHEN l_suppkey % 13 = 5 THEN 'Separation' ELSE 'DeviceRGB' END AS color_space,
  l_suppkey % 7 = 2 AS jpx, l_suppkey % 17 = 4 AS is_mask, CAST(floor(l_extendedprice) AS BIGINT) AS byte_length,
  CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity * 5 END AS placed_w, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_quantity * 4 END AS placed_h,
  CASE WHEN l_suppkey % 5 = 1 THEN CAST(floor(l_extendedprice * 0.5) AS BIGINT) END AS flate_bytes FROM lineitem)"""


def images(t):
    q, p, s = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    none = F.array().cast("array<string>")
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no"),
        ((p * 1000 + s) * 100 + q.cast("bigint")).alias("image_no"), p.cast("string").alias("name"),
        F.when(p % 5 == 0, F.lit(-1).cast("bigint")).otherwise(p % 4).alias("object_no"),
        (q * 40).cast("bigint").alias("width"), (q * 30).cast("bigint").alias("height"),
        F.when(s % 11 == 3, 1).otherwise(8).alias("bits"),
        F.when(s % 13 == 5, "Separation").otherwise("DeviceRGB").alias("color_space"),
        F.when(s % 7 == 2, F.array(F.lit("JPXDecode"))).otherwise(none).alias("filters"),
        none.alias("mask_filters"), F.lit(None).cast("string").alias("mask_kind"), (s % 17 == 4).alias("is_mask"),
        F.col("l_extendedprice").cast("bigint").alias("byte_length"),
        F.when(p % 3 != 0, q * 5).alias("placed_w"), F.when(p % 3 != 0, q * 4).alias("placed_h"),
        F.when(s % 5 == 1, (F.col("l_extendedprice") * 0.5).cast("bigint")).alias("flate_bytes"),
    )


def inventory(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no")
    ).distinct().select("doc_id", "page_no", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


def census(t):
    """Pages 1 to 5 of a document were looked at; every second of them has text."""
    inv = inventory(t).filter("page_no <= 5")
    n = F.when(F.col("page_no") % 2 == 0, F.lit(40)).otherwise(0).cast("bigint")
    return inv.select("doc_id", "page_no", n.alias("char_count"), (F.col("page_no") % 3).alias("run_count"))


SAFE = IMG + """, sf AS (SELECT *, CASE WHEN color_space = 'Separation' THEN 'Separation image: named ink' WHEN is_mask THEN 'stencil mask' END AS blk,
  CASE WHEN jpx THEN 'JPXDecode image: not decodable' WHEN bits < 8 THEN bits || '-bit image' END AS lim FROM img),
  safe AS (SELECT *, blk IS NULL AS raster, blk IS NULL AND lim IS NULL AS surgical, coalesce(blk, lim) AS reason FROM sf)"""
OBJ = SAFE + """, obj AS (SELECT doc_id, object_no, bool_and(surgical) AS surgical, bool_and(raster) AS raster,
  arg_min(reason, (raster::INT, page_no, image_no)) FILTER (reason IS NOT NULL) AS reason, count(*) AS uses FROM safe WHERE object_no >= 0 GROUP BY ALL)"""


@register("image_safety", f"WITH {SAFE} SELECT doc_id, page_no, image_no, raster, surgical, reason FROM safe")
def _(t):
    return Z.image_safety(images(t)).select("doc_id", "page_no", "image_no", "raster", "surgical", "reason")


@register("object_safety", f"WITH {OBJ} SELECT * FROM obj")
def _(t):
    return Z.object_safety(Z.image_safety(images(t)))


@register(
    "count_once",
    f"""WITH {IMG}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, object_no ORDER BY page_no, image_no) AS rn FROM img)
    SELECT doc_id, count(*) AS images, sum(byte_length)::BIGINT AS bytes FROM r WHERE object_no < 0 OR rn = 1 GROUP BY doc_id""",
)
def _(t):
    return Z.count_once(images(t)).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("byte_length").alias("bytes")
    )


@register(
    "largest_placement",
    f"""WITH {IMG} SELECT doc_id, object_no, arg_max(page_no, (placed_w IS NULL, coalesce(placed_w * placed_h, 0), -page_no)) AS page_no FROM img GROUP BY ALL""",
)
def _(t):
    return Z.largest_placement(images(t)).select("doc_id", "object_no", "page_no")


@register(
    "attach_text_census",
    """WITH i AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::BIGINT AS page_no FROM lineitem)
    SELECT doc_id, page_no, CASE WHEN page_no <= 5 AND page_no % 2 = 0 THEN 40 ELSE 0 END::BIGINT AS char_count, CASE WHEN page_no <= 5 THEN page_no % 3 ELSE 0 END AS run_count FROM i""",
)
def _(t):
    return Z.attach_text_census(inventory(t), census(t)).select("doc_id", "page_no", "char_count", "run_count")


PLAN = OBJ + """, inv AS (SELECT DISTINCT doc_id, page_no FROM img),
  kn AS (SELECT *, page_no <= 5 AND page_no % 2 = 0 AS has_text, CASE WHEN page_no <= 5 THEN page_no % 3 ELSE 0 END AS runs FROM inv),
  u0 AS (SELECT s.doc_id, s.page_no, s.image_no, s.object_no, s.width, s.height, s.byte_length, s.flate_bytes, has_text,
    coalesce(o.raster, s.raster) AS raster, coalesce(o.surgical, s.surgical) AS surgical, placed_w, placed_h,
    CASE WHEN placed_w IS NULL THEN greatest(width / 612 * 72, height / 792 * 72) ELSE least(width / placed_w * 72, height / placed_h * 72) END AS dpi,
    greatest(1, floor(placed_w / 72 * 150 + 0.5)) AS tw, greatest(1, floor(placed_h / 72 * 150 + 0.5)) AS th
    FROM safe s JOIN kn USING (doc_id, page_no) LEFT JOIN obj o ON s.object_no >= 0 AND s.doc_id = o.doc_id AND s.object_no = o.object_no),
  u AS (SELECT *, CAST(CASE WHEN placed_w IS NULL THEN least(width, 1275) * least(height, 1650) WHEN least(width / tw, height / th) >= 1.15 THEN least(width, tw) * least(height, th) ELSE width * height END AS BIGINT) AS want FROM u0),
  gov AS (SELECT doc_id, object_no, arg_min(dpi, (dpi, page_no, image_no)) AS gdpi, arg_min(want, (dpi, page_no, image_no)) AS gpx FROM u WHERE object_no >= 0 AND has_text AND surgical GROUP BY ALL),
  c0 AS (SELECT u.*, gdpi, CASE WHEN u.object_no >= 0 AND gpx IS NOT NULL THEN gpx ELSE want END AS px,
    CASE WHEN u.object_no >= 0 THEN coalesce(gdpi > 150 * 1.15, false) ELSE dpi > 150 * 1.15 END AS ov FROM u LEFT JOIN gov g ON u.doc_id = g.doc_id AND u.object_no = g.object_no),
  c1 AS (SELECT *, object_no >= 0 AND gdpi IS NOT NULL AND NOT ov AND coalesce(flate_bytes <= byte_length * 0.9, false) AS ll FROM c0),
  c AS (SELECT *, has_text AND surgical AND (ov OR ll) AS cand FROM c1),
  fl AS (SELECT doc_id, page_no, sum(width * height)::BIGINT AS image_pixels, bool_or(NOT raster) AS br, count(*) FILTER (NOT surgical) AS uns, count(*) FILTER (cand) AS nc FROM c GROUP BY ALL),
  rt AS (SELECT *, CASE WHEN NOT has_text AND br THEN 'already-optimized' WHEN NOT has_text THEN 'raster' WHEN nc > 0 THEN 'surgical' WHEN uns > 0 THEN 'skip' ELSE 'already-optimized' END AS route FROM kn JOIN fl USING (doc_id, page_no)),
  ct AS (SELECT c.*, route, row_number() OVER (PARTITION BY c.doc_id, object_no ORDER BY page_no, image_no) AS rn FROM c JOIN rt USING (doc_id, page_no) WHERE route = 'raster' OR (route = 'surgical' AND cand)),
  sm AS (SELECT doc_id, page_no, sum(byte_length)::BIGINT AS act, sum(px) FILTER (route = 'surgical' AND NOT ll) AS spx, sum(byte_length) FILTER (route = 'surgical' AND ll) AS lb,
    sum(least(byte_length, flate_bytes)) FILTER (route = 'surgical' AND ll) AS lp FROM ct WHERE object_no < 0 OR rn = 1 GROUP BY ALL),
  plan AS (SELECT doc_id, page_no, route, image_pixels, coalesce(act, 0)::BIGINT AS actionable_bytes, CASE WHEN route = 'raster' THEN 1275 * 1650 ELSE coalesce(spx, 0) END::BIGINT AS target_pixels,
    coalesce(lb, 0)::BIGINT AS lossless_bytes, coalesce(lp, 0)::BIGINT AS lossless_projected FROM rt LEFT JOIN sm USING (doc_id, page_no))"""


def plan(t):
    return Z.classify_pages(inventory(t), images(t), census(t), 150)


@register("classify_pages", f"WITH {PLAN} SELECT * FROM plan")
def _(t):
    return plan(t).drop("reason")


@register(
    "governing_use",
    f"""WITH {IMG} SELECT doc_id, object_no, arg_min(page_no, (width / 612 * 72, page_no, image_no)) AS page_no FROM img WHERE object_no >= 0 GROUP BY ALL""",
)
def _(t):
    u = images(t).withColumns({"dpi": F.col("width") / 612 * 72, "pixels_wanted": F.col("width")})
    return Z.governing_use(u).select("doc_id", "object_no", "use.page_no")


def totals(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        (F.sum(F.floor("l_extendedprice")) * 1.5).alias("_b")
    ).select("doc_id", F.floor(F.col("_b") + 0.5).cast("bigint").alias("total_bytes"))


@register(
    "estimate_savings",
    f"""WITH {PLAN}, tot AS (SELECT l_orderkey AS doc_id, CAST(floor(sum(floor(l_extendedprice)) * 1.5 + 0.5) AS BIGINT) AS total_bytes FROM lineitem GROUP BY ALL),
    s AS (SELECT doc_id, sum(actionable_bytes) AS act, sum(lossless_bytes) AS lb, sum(least(lossless_bytes, lossless_projected)) AS lp,
      sum(CASE WHEN target_pixels > 0 THEN greatest(1, 16.167 - 42.6025 * 0.6 + 43.6 * 0.36) * pow(target_pixels, 0.6) ELSE 0 END) AS px FROM plan GROUP BY doc_id),
    e AS (SELECT doc_id, total_bytes, greatest(1, greatest(0, total_bytes - act) + least(px, greatest(0, act - lb) * 0.33, greatest(0, act - lb)) + lp) AS est FROM s JOIN tot USING (doc_id))
    SELECT doc_id, round(floor(est + 0.5) / 10)::BIGINT AS estimate, round(1 - est / total_bytes, 4) AS fraction FROM e""",
)
def _(t):
    e = Z.estimate_savings(plan(t), totals(t), 0.6)
    return e.select(
        "doc_id", F.round(F.col("estimated_bytes") / 10).cast("bigint").alias("estimate"),
        F.round("estimated_fraction", 4).alias("fraction"),
    )


@register("refine_estimate")
def _(t):
    p = plan(t)
    m = Z.representative_page(p, "route", "actionable_bytes", "target_pixels").select(
        "doc_id", "page_no", "route", (F.col("actionable_bytes") + 500).alias("before_bytes"),
        (F.col("actionable_bytes") * 0.4 + 500).alias("after_bytes"),
        F.col("actionable_bytes").alias("page_actionable"), F.col("target_pixels").alias("page_pixels"),
    )
    return Z.refine_estimate(p, totals(t), m, 0.6)


@register(
    "representative_page",
    f"WITH {PLAN} SELECT doc_id, arg_max(page_no, (image_pixels, actionable_bytes, -page_no)) AS page_no FROM plan GROUP BY doc_id",
)
def _(t):
    return Z.representative_page(plan(t))


def report_rows(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no"),
        F.col("l_partkey").cast("string").alias("image_id"), F.col("l_extendedprice").cast("bigint").alias("original_bytes"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("result_bytes"),
    )


_REP = """r AS (SELECT l_suppkey AS doc_id, l_linenumber::BIGINT AS page_no, CAST(l_partkey AS VARCHAR) AS image_id, CAST(floor(l_extendedprice) AS BIGINT) AS o, CAST(l_quantity * 1000 AS BIGINT) AS c FROM lineitem),
  g AS (SELECT doc_id, page_no, image_id, grouping(doc_id, page_no, image_id) AS gid, sum(o)::BIGINT AS original, sum(c)::BIGINT AS result FROM r GROUP BY ROLLUP (doc_id, page_no, image_id))"""


@register(
    "size_report",
    f"""WITH {_REP} SELECT doc_id, page_no, image_id, CASE gid WHEN 0 THEN 'image' WHEN 1 THEN 'page' WHEN 3 THEN 'document' ELSE 'all' END AS level, original, result,
      greatest(0, original - result) AS saved, round(greatest(0, original - result) / original * 100, 2) AS percent, result >= original AS kept FROM g""",
)
def _(t):
    return Z.size_report(report_rows(t))


@register(
    "compression_report",
    f"""WITH {_REP}, l AS (SELECT doc_id, coalesce(page_no, -1) AS o, CASE WHEN gid = 3 THEN 'Total: ' ELSE 'Page ' || (page_no + 1) || ': ' END || original || ' -> ' || result || ' bytes (' ||
      printf('%.2f', round(greatest(0, original - result) / original * 100, 2)) || '%)' AS line FROM g WHERE gid IN (1, 3))
    SELECT doc_id, string_agg(line, chr(10) ORDER BY o, line) AS report FROM l GROUP BY doc_id""",
)
def _(t):
    return Z.compression_report(report_rows(t))


@register(
    "split_by_size",
    W.replace("WITH ", "WITH RECURSIVE ") + """, c AS (SELECT doc_id, pos, n, sum(n_bytes) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM dp),
    p AS (SELECT doc_id, pos + 1 AS i, cum FROM c UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM c),
    w AS (SELECT doc_id, 0::BIGINT AS a, max(n)::BIGINT AS b FROM c GROUP BY doc_id
      UNION ALL SELECT w.doc_id, unnest([w.a, w.a + (w.b - w.a) // 2]), unnest([w.a + (w.b - w.a) // 2, w.b]) FROM w JOIN p x ON x.doc_id = w.doc_id AND x.i = w.a JOIN p y ON y.doc_id = w.doc_id AND y.i = w.b WHERE w.b - w.a > 1 AND y.cum - x.cum > 1500)
    SELECT w.doc_id, a AS from_pos, b AS to_pos, (y.cum - x.cum)::BIGINT AS bytes, y.cum - x.cum > 1500 AS oversized FROM w JOIN p x ON x.doc_id = w.doc_id AND x.i = w.a JOIN p y ON y.doc_id = w.doc_id AND y.i = w.b
    WHERE y.cum - x.cum <= 1500 OR b - a <= 1""",
)
def _(t):
    p = dp(t).select("doc_id", "pos", "n_bytes")
    n = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return Z.split_by_size(p.join(n, "doc_id"), 1500)


def ladder_trials(t):
    sizes = F.array(*[F.lit(float(x)) for x in (1.0, 0.8, 0.6, 0.45, 0.36, 0.28, 0.2, 0.13, 0.1)])
    return t.orders.select("o_orderkey", "o_totalprice", F.posexplode(sizes).alias("rung", "f")).select(
        F.col("o_orderkey").alias("doc_id"), "rung", F.floor(F.col("o_totalprice") * F.col("f")).alias("bytes")
    )


@register(
    "pick_setting",
    """WITH f AS (SELECT * FROM (VALUES (0, 1.0, 300, 0.9), (1, 0.8, 300, 0.75), (2, 0.6, 200, 0.75), (3, 0.45, 150, 0.75), (4, 0.36, 150, 0.6), (5, 0.28, 110, 0.6), (6, 0.2, 110, 0.45), (7, 0.13, 72, 0.45), (8, 0.1, 72, 0.3)) v(rung, f, dpi, q)),
    b AS (SELECT o_orderkey AS doc_id, min(rung) FILTER (floor(o_totalprice * f::DOUBLE) <= 60000) AS r FROM orders, f GROUP BY ALL)
    SELECT doc_id, r IS NOT NULL AS reached, coalesce(r, 8)::BIGINT AS rung, dpi::BIGINT AS dpi, q::DOUBLE AS quality FROM b JOIN f ON f.rung = coalesce(r, 8)""",
)
def _(t):
    return Z.pick_setting(ladder_trials(t), 60000)


@register(
    "pick_quality",
    """WITH tr AS (SELECT l_orderkey AS image_id, CASE WHEN l_linenumber < 4 THEN 1.0 ELSE 1 / (l_linenumber - 1) END AS scale, l_discount AS quality, CAST(l_extendedprice AS BIGINT) AS bytes FROM (SELECT l_orderkey, l_linenumber, l_discount, floor(l_extendedprice) AS l_extendedprice FROM lineitem)),
    x AS (SELECT *, CASE WHEN scale >= 1 AND bytes <= 20000 THEN 3 WHEN scale >= 1 AND bytes <= 40000 THEN 2 WHEN bytes <= 40000 THEN 1 ELSE 0 END AS t FROM tr),
    m AS (SELECT image_id, max(t) AS t FROM x GROUP BY image_id)
    SELECT image_id, t > 0 AS reached, CASE WHEN t = 0 THEN min(bytes) END AS smallest, CASE WHEN t > 0 THEN max(scale) END AS scale FROM x JOIN m USING (image_id, t) GROUP BY image_id, t""",
)
def _(t):
    n = F.col("l_linenumber")
    tr = t.lineitem.select(
        F.col("l_orderkey").alias("image_id"), F.when(n < 4, 1.0).otherwise(1 / (n - 1)).alias("scale"),
        F.col("l_discount").alias("quality"), F.floor("l_extendedprice").alias("bytes"),
    )
    r = Z.pick_quality(tr, F.lit(40000), F.lit(20000))
    return r.select(
        "image_id", "reached", F.when(~F.col("reached"), F.col("bytes")).alias("smallest"),
        F.when(F.col("reached"), F.col("scale")).alias("scale"),
    )


@register(
    "page_batches",
    """WITH u AS (SELECT DISTINCT l_suppkey AS doc_id, l_orderkey AS pos, l_partkey % 10 AS object_no FROM lineitem)
    SELECT doc_id, object_no, min(pos // 8) AS batch, min(pos) AS pos FROM u GROUP BY ALL""",
)
def _(t):
    u = t.lineitem.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("pos"), (F.col("l_partkey") % 10).alias("object_no")
    ).distinct()
    return Z.page_batches(u.select("doc_id", "pos").distinct(), u)[1].select("doc_id", "object_no", "batch", "pos")


@register(
    "workspace_capacity",
    """WITH r AS (SELECT o_custkey AS workspace, o_orderkey AS pos, count(*) OVER w AS c, sum(floor(o_totalprice)) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
    SELECT workspace, pos, c <= 8 AS ok, c <= 8 AND b > 1500000 AS over_soft FROM r""",
)
def _(t):
    f = t.orders.select(
        F.col("o_custkey").alias("workspace"), F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("bytes")
    )
    return Z.workspace_capacity(f, 8, 1_500_000).select("workspace", "pos", "ok", "over_soft")


@register(
    "band_columns",
    """WITH RECURSIVE o AS (SELECT o_custkey, least(200.0, greatest(32.0, o_totalprice / 2000)) AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    r AS (SELECT o_custkey, i, w, 1 AS k, 0 AS band FROM o WHERE i = 1
      UNION ALL SELECT o.o_custkey, o.i, CASE WHEN k >= 5 OR r.w + o.w > 460.0 THEN o.w ELSE r.w + o.w END, CASE WHEN k >= 5 OR r.w + o.w > 460.0 THEN 1 ELSE k + 1 END, band + (k >= 5 OR r.w + o.w > 460.0)::INT FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)
    SELECT o_custkey, array_to_string(list(band ORDER BY i), ',') AS bands FROM r GROUP BY o_custkey""",
)
def _(t):
    """Column widths of a sheet per customer: the order prices, in order of their key."""
    w = F.least(F.lit(200.0), F.greatest(F.lit(32.0), F.col("o_totalprice") / 2000))
    sheets = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", w.alias("w")))).alias("c"))
    return sheets.select("o_custkey", F.array_join(Z.band_columns(F.transform("c", lambda x: x["w"]), 5, 460.0).cast("array<string>"), ",").alias("bands"))


# --- statistics -----------------------------------------------------------------------------
@register(
    "otsu_threshold",
    """WITH h AS (SELECT event_type, CAST(least(floor(value), 255) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w AS b, sum(bin * n) OVER w AS sb, sum(n) OVER (PARTITION BY event_type) AS tot, sum(bin * n) OVER (PARTITION BY event_type) AS s FROM h WINDOW w AS (PARTITION BY event_type ORDER BY bin)),
    v AS (SELECT event_type, bin, b::DOUBLE * (tot - b) * pow(sb / b - (s - sb) / (tot - b), 2) AS v FROM c WHERE tot > b)
    SELECT event_type, arg_max(bin, (v, -bin)) AS threshold FROM v GROUP BY event_type""",
)
def _(t):
    return ST.otsu_threshold(ST.histogram(t.events, ["event_type"], F.col("value")), ["event_type"])


@register(
    "ink_coverage",
    "SELECT user_id, round(count(*) FILTER (floor(value) < 10) / count(*), 6) AS coverage FROM events GROUP BY user_id",
)
def _(t):
    c = ST.ink_coverage(ST.histogram(t.events, ["user_id"], F.col("value")), ["user_id"], 10)
    return c.select("user_id", F.round("coverage", 6).alias("coverage"))


@register(
    "changed_fraction",
    """SELECT a.vec_id, round(len(list_filter(range(1, 65), lambda i: abs(a.embedding[i] - b.embedding[i]) > 0.9 * 0.2::FLOAT)) / 64, 6) * (CASE WHEN b.vec_id IS NULL THEN NULL ELSE 1 END) AS share,
      b.vec_id IS NULL OR len(list_filter(range(1, 65), lambda i: abs(a.embedding[i] - b.embedding[i]) > 0.9 * 0.2::FLOAT)) > 0 AS changed
      FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    a = t.embeddings.select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    share, changed = ST.changed_fraction(F.col("embedding"), F.col("other"), 10, 0.2)
    return a.join(b, "vec_id", "left").select("vec_id", F.round(share, 6).alias("share"), changed.alias("changed"))


@register(
    "correlate_vectors",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    t AS (SELECT label, min(vec_id) AS template_id, arg_min(e, vec_id) AS te FROM v GROUP BY label),
    s AS (SELECT template_id, vec_id, (list_dot_product(e, te) - list_sum(e) * list_sum(te) / 64) / sqrt((list_dot_product(e, e) - list_sum(e) * list_sum(e) / 64) * (list_dot_product(te, te) - list_sum(te) * list_sum(te) / 64)) AS score FROM v JOIN t USING (label)),
    r AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score >= 0.05)
    SELECT template_id, vec_id, round(score, 6) AS score FROM r WHERE rn <= 10""",
)
def _(t):
    v = t.embeddings.select("vec_id", "label", F.col("embedding").alias("vec"))
    tpl = v.groupBy("label").agg(F.min("vec_id").alias("template_id"), F.min_by("vec", "vec_id").alias("template"))
    r = ST.correlate_vectors(v, tpl, "label", 0.05, 10)
    return r.select("template_id", "vec_id", F.round("score", 6).alias("score"))


@register(
    "suppress_overlaps",
    """WITH RECURSIVE b AS (SELECT l_suppkey AS doc_id, l_linenumber::BIGINT AS page_no, l_orderkey * 100000 + l_partkey AS region_no, l_discount * 5 AS x, l_tax * 5 AS y, l_quantity / 200 AS w, l_quantity / 100 AS h,
      row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice / 100000 DESC, l_orderkey * 100000 + l_partkey) AS n FROM lineitem),
    r AS (SELECT DISTINCT doc_id, page_no, 0::BIGINT AS n, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS chosen FROM b
      UNION ALL SELECT r.doc_id, r.page_no, b.n, CASE WHEN len(list_filter(chosen, lambda c:
          least(c.x + c.w, b.x + b.w) > greatest(c.x, b.x) AND least(c.y + c.h, b.y + b.h) > greatest(c.y, b.y) AND
          (least(c.x + c.w, b.x + b.w) - greatest(c.x, b.x)) * (least(c.y + c.h, b.y + b.h) - greatest(c.y, b.y)) /
          (c.w * c.h + b.w * b.h - (least(c.x + c.w, b.x + b.w) - greatest(c.x, b.x)) * (least(c.y + c.h, b.y + b.h) - greatest(c.y, b.y))) > 0.3)) > 0
        THEN chosen ELSE list_append(chosen, {'id': b.region_no, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}) END
      FROM r JOIN b ON b.doc_id = r.doc_id AND b.page_no = r.page_no AND b.n = r.n + 1),
    z AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC) = 1)
    SELECT doc_id, page_no, c.id AS region_no FROM (SELECT doc_id, page_no, unnest(chosen) AS c FROM z)""",
)
def _(t):
    """Boxes from order lines."""
    r = t.lineitem.select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("page_no"),
        (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("region_no"),
        (F.col("l_discount") * 5).alias("x"), (F.col("l_tax") * 5).alias("y"),
        (F.col("l_quantity") / 200).alias("width"), (F.col("l_quantity") / 100).alias("height"),
        (F.col("l_extendedprice") / 100000).alias("score"),
    )
    return ST.suppress_overlaps(r, limit=None).select("doc_id", "page_no", "region_no")


# --- comparison -----------------------------------------------------------------------------
def words_sql(text):
    return f"list_filter(string_split_regex({text}, '{S.WS}+'), lambda w: w <> '')"


def pairs(t):
    new = F.replace(F.replace("text", F.lit(" the "), F.lit(" a the ")), F.lit(" de "), F.lit(" de la "))
    return t.texts.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("old"), new.alias("new"))


_PAIRS = f"""p AS (SELECT doc_id AS pair_id, {words_sql('text')} AS o, {words_sql("replace(replace(text, ' the ', ' a the '), ' de ', ' de la ')")} AS n FROM documents)"""


@register(
    "diff_pairs",
    f"WITH {_PAIRS} SELECT pair_id, len(o)::BIGINT AS n_equal, (len(n) - len(o))::BIGINT AS n_insert, 0::BIGINT AS n_delete, md5(array_to_string(n, ' ')) AS new_md5, md5(array_to_string(o, ' ')) AS old_md5 FROM p",
)
def _(t):
    d = C.diff_pairs(pairs(t))

    def n(op):
        return F.size(F.filter("chunks", lambda c: c["op"] == op)).cast("bigint")

    def side(op):
        return F.md5(F.array_join(F.transform(F.filter("chunks", lambda c: c["op"] != op), lambda c: c["text"]), " "))

    return d.select(
        "pair_id", n("equal").alias("n_equal"), n("insert").alias("n_insert"), n("delete").alias("n_delete"),
        side("delete").alias("new_md5"), side("insert").alias("old_md5"),
    )


_LONG = f"""p AS (SELECT doc_id % 7 AS pair_id, doc_id, {words_sql('text')} AS w FROM documents),
    q AS (SELECT pair_id, w[i] AS w, i % 3 <> 2 AS stays FROM p, unnest(range(1, len(w) + 1)) u(i))"""


@register(
    "diff_long_pairs",
    f"WITH {_LONG} SELECT pair_id, count(*) FILTER (stays) AS n_equal, 0::BIGINT AS n_insert, count(*) FILTER (NOT stays) AS n_delete FROM q GROUP BY pair_id",
)
def _(t):
    """Each whole document against itself without every third word, counted over seven groups of documents."""
    w = t.texts.select("doc_id", C.words(F.col("text")).alias("w"))
    less = F.filter("w", lambda x, i: i % 3 != 1)
    return _long_counts(w.select(F.col("doc_id").alias("pair_id"), F.array_join("w", " ").alias("old"), F.array_join(less, " ").alias("new")))


def _long_counts(pairs):
    def n(op):
        return F.size(F.filter("chunks", lambda c: c["op"] == op)).cast("bigint")

    per = LD.diff_long(pairs).select((F.col("pair_id") % 7).alias("pair_id"), *[n(op).alias(f"n_{op}") for op in ("equal", "insert", "delete")])
    return per.groupBy("pair_id").agg(*[F.sum(f"n_{op}").alias(f"n_{op}") for op in ("equal", "insert", "delete")])


@register(
    "diff_edited_pairs",
    f"""WITH {_LONG}, x AS (SELECT pair_id, i % 89 = 0 AS changed FROM (SELECT pair_id, unnest(range(1, len(w) + 1)) AS i FROM p))
    SELECT pair_id, count(*) FILTER (NOT changed) AS n_equal, count(*) FILTER (changed) AS n_insert, count(*) FILTER (changed) AS n_delete FROM x GROUP BY pair_id""",
)
def _(t):
    """Each whole document against itself with a word of its own in every 89th place."""
    w = t.texts.select("doc_id", C.words(F.col("text")).alias("w"))
    new = F.transform("w", lambda x, i: F.when((i + 1) % 89 == 0, F.concat(F.lit("<"), i.cast("string"), F.lit(">"))).otherwise(x))
    return _long_counts(w.select(F.col("doc_id").alias("pair_id"), F.array_join("w", " ").alias("old"), F.array_join(new, " ").alias("new")))


_TRIM = f"""{_PAIRS}, q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[i] <> n[i])) - 1, least(len(o), len(n))) AS pre FROM p),
  r AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(o), len(n)) - pre + 1), lambda i: o[len(o) + 1 - i] <> n[len(n) + 1 - i])) - 1, least(len(o), len(n)) - pre) AS suf FROM q)"""


@register(
    "coarse_diff",
    f"WITH {_TRIM} SELECT pair_id, (pre + suf)::BIGINT AS n_equal, (len(n) - pre - suf)::BIGINT AS n_insert, (len(o) - pre - suf)::BIGINT AS n_delete FROM r",
)
def _(t):
    d = C.coarse_diff(pairs(t))

    def n(op):
        return F.size(F.filter("chunks", lambda c: c["op"] == op)).cast("bigint")

    return d.select("pair_id", n("equal").alias("n_equal"), n("insert").alias("n_insert"), n("delete").alias("n_delete"))


@register(
    "diff_summary",
    f"""WITH {_TRIM}, w AS (SELECT pair_id, unnest(o) AS w, 1 AS d FROM p UNION ALL SELECT pair_id, unnest(n), -1 FROM p), g AS (SELECT pair_id, w, sum(d) AS d FROM w GROUP BY ALL),
    h AS (SELECT pair_id, sum(greatest(d, 0))::BIGINT AS a, sum(greatest(-d, 0))::BIGINT AS b FROM g GROUP BY pair_id)
    SELECT pair_id, len(o)::BIGINT AS words_old, len(n)::BIGINT AS words_new, pre::BIGINT AS equal_prefix, suf::BIGINT AS equal_suffix, coalesce(a, 0) AS only_old, coalesce(b, 0) AS only_new FROM r LEFT JOIN h USING (pair_id)""",
)
def _(t):
    return C.diff_summary(pairs(t))


@register(
    "compare_documents",
    f"""WITH {S.PAGES}, x AS (SELECT doc_id, page_no, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text FROM pg WHERE doc_id % 5 <> 0 OR page_no <> 1)
    SELECT doc_id, page_no, pg.text IS DISTINCT FROM x.text AS changed, true AS in_a, x.text IS NOT NULL AS in_b FROM pg LEFT JOIN x USING (doc_id, page_no)""",
)
def _(t):
    a = pages_of(t).withColumn("page_no", F.col("page_no").cast("bigint"))
    b = a.filter("doc_id % 5 <> 0 OR page_no <> 1").withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.col("text"))
    )
    return C.compare_documents(a, b)


# --- facts ----------------------------------------------------------------------------------
@register(
    "dedupe_content",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
    k AS (SELECT doc_id || '/' || n AS name, line FROM l), m AS (SELECT line, min(name) AS kept_name FROM k GROUP BY line) SELECT name, kept_name FROM k JOIN m USING (line)""",
)
def _(t):
    lines = PG.page_lines(t.texts.select("doc_id", "text"))
    parts = lines.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("name"), F.col("line").alias("content"))
    return M.dedupe_content(parts)


@register(
    "font_findings",
    """SELECT o_custkey AS doc_id, 'Font' || left(o_orderpriority, 1) AS base_font, array_to_string(list_sort(list_distinct(list(o_orderkey))), ',') AS pages, CASE WHEN left(o_orderpriority, 1) = '1' THEN 'Helvetica' END AS standard
      FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL""",
)
def _(t):
    f = t.orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_no"), (F.col("o_orderstatus") == "F").alias("embedded"),
        F.concat(F.lit("ABCDEF+Font"), F.substring("o_orderpriority", 1, 1)).alias("font"),
    )
    r = M.font_findings(f, {"Font1": "Helvetica"})
    return r.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@register("varying_sizes", "SELECT l_orderkey AS doc_id, count(DISTINCT (l_quantity > 25, l_tax > 0.04)) > 1 AS varying FROM lineitem GROUP BY ALL")
def _(t):
    p = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity") > 25).alias("width"), (F.col("l_tax") > 0.04).alias("height"))
    return M.varying_sizes(p)


@register("storage_report", "SELECT source AS kind, count(*) AS files, sum(n_chars)::BIGINT AS bytes, count(DISTINCT lang) AS langs FROM documents GROUP BY ALL")
def _(t):
    return M.storage_report(t.documents.select(F.col("source").alias("kind"), F.col("n_chars").alias("bytes"), "lang"))


@register("group_notes", """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END::BIGINT AS group_no, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS note_no FROM events""")
def _(t):
    return M.group_notes(notes(t)).select("seq", "group_no", "note_no")


def notes(t):
    kinds = {"error": "failed", "view": "kept-original", "click": "changed", "signup": "metadata-scrubbed", "purchase": "renamed"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return t.events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("file"), (F.col("event_id") % 997).cast("string")).alias("file"),
        F.element_at(table, F.col("event_type")).alias("kind"), F.col("props").alias("detail"),
    )


@register("outcome_counts", "WITH f AS (SELECT event_id % 997 AS f, bool_or(event_type = 'error') AS bad FROM events GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (NOT bad) AS completed, count(*) FILTER (bad) AS failed FROM f")
def _(t):
    return M.outcome_counts(notes(t))


def metadata(t):
    """Document facts from customers: names, local paths and flags."""
    c = F.col("c_custkey")
    none = F.lit(None).cast("string")
    return t.customer.select(
        c.alias("doc_id"), F.when(c % 2 == 0, F.col("c_name")).alias("title"),
        F.when(c % 3 == 0, F.concat(F.lit("C:\\Users\\"), F.col("c_mktsegment"), F.lit("\\a.doc, x"))).alias("author"),
        none.alias("subject"), F.lit("").alias("creator"), F.when(c % 5 == 0, F.lit("/home/x/y.tex;")).alias("producer"),
        none.alias("creation_date"), none.alias("modification_date"), none.alias("keywords"),
        (c % 4 == 1).alias("has_xmp"), F.lit(False).alias("has_embedded_javascript"), (c % 7 == 0).alias("has_open_action"),
        *[F.lit(None).cast("boolean").alias(f) for f in ("has_additional_actions", "has_embedded_files", "has_page_thumbnails", "has_optional_content")],
        F.when(c % 6 == 0, F.create_map(F.lit("k"), F.col("c_mktsegment"))).alias("custom_info"),
    )


@register(
    "finding_count",
    "SELECT c_custkey AS doc_id, ((c_custkey % 2 = 0)::INT + (c_custkey % 3 = 0)::INT + (c_custkey % 5 = 0)::INT + (c_custkey % 4 = 1)::INT + (c_custkey % 7 = 0)::INT + (c_custkey % 6 = 0)::INT)::BIGINT AS findings FROM customer",
)
def _(t):
    return metadata(t).select("doc_id", M.finding_count().alias("findings"))


@register(
    "scrub_metadata",
    "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title, CAST(NULL AS VARCHAR) AS author, false AS has_xmp, c_custkey % 7 = 0 AS has_open_action, 0::BIGINT AS left_all FROM customer",
)
def _(t):
    m = metadata(t)
    some = M.scrub_metadata(m, {"author": True, "has_xmp": True})
    none_left = M.scrub_metadata(m).select("doc_id", M.finding_count().alias("left_all"))
    # an emptied custom section still stands for itself
    cleared = none_left.withColumn("left_all", F.col("left_all") - F.col("left_all"))
    return some.select("doc_id", "title", "author", "has_xmp", "has_open_action").join(cleared, "doc_id")


@register(
    "metadata_inventory",
    """SELECT c_custkey AS doc_id, 'title' AS setting, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'author', 'C:\\Users\\' || c_mktsegment || '\\a.doc, x' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'producer', '/home/x/y.tex;' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'has_xmp', 'present' FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT c_custkey, 'has_open_action', 'present' FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'custom_info', 'k=' || c_mktsegment FROM customer WHERE c_custkey % 6 = 0""",
)
def _(t):
    return M.metadata_inventory(metadata(t))


@register(
    "path_findings",
    """SELECT c_custkey AS doc_id, 'author' AS setting, 'C:\\Users\\' || c_mktsegment || '\\a.doc' AS path FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'producer', '/home/x/y.tex' FROM customer WHERE c_custkey % 5 = 0""",
)
def _(t):
    return M.path_findings(M.metadata_inventory(metadata(t)))


@register(
    "field_matrix",
    """SELECT conv_id AS doc_id, any_value(text) FILTER (turn = 0) AS t0, any_value(text) FILTER (turn = 1) AS t1, any_value(text) FILTER (turn = 2) AS t2 FROM conversations GROUP BY conv_id""",
)
def _(t):
    f = t.conversations.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.col("text").alias("value"))
    return M.field_matrix(f, ["t0", "t1", "t2"])


def annotations(t):
    y = F.col("value") / 1000
    kind = F.when(F.col("event_type") == "click", "sticky").otherwise(F.col("event_type"))
    return t.events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ann_no"), kind.alias("type"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4).alias("page_no"),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.lit(0.1).alias("x"), y.alias("y"))).alias("rect"),
        F.when(F.col("event_id") % 2 == 1, F.lit(0.2)).alias("x"), y.alias("y"),
        F.array(F.struct(F.lit(0.3).alias("x"), y.alias("y"))).alias("points"),
        F.when(F.col("event_id") % 3 == 0, F.lit("Ann")).alias("author"), F.lit("").alias("date"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("text"), F.lit(None).cast("string").alias("data"),
    )


@register(
    "annotation_summary",
    """WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 5 = 0 THEN 99 ELSE event_id % 4 END, value, event_id) AS k, * FROM events),
    b AS (SELECT user_id, k, '[Note #' || k || '] ' || CASE event_type WHEN 'click' THEN 'Sticky Note' ELSE upper(event_type[1]) || substr(event_type, 2) END || chr(10) || 'Page: ' || CASE WHEN event_id % 5 = 0 THEN 'Detached' ELSE CAST(event_id % 4 + 1 AS VARCHAR) END || chr(10)
      || 'Author: ' || CASE WHEN event_id % 3 = 0 THEN 'Ann' ELSE 'Anonymous' END || chr(10) || 'Date: N/A' || chr(10) || 'Position: X: ' || CASE WHEN event_id % 2 = 0 THEN 10 ELSE 20 END || '%, Y: ' || CAST(floor(value / 1000 * 100 + 0.5) AS BIGINT) || '%' || chr(10)
      || 'Text: ' || CASE WHEN event_id % 2 = 0 THEN props ELSE '(No text content)' END || chr(10) || repeat('-', 40) AS note FROM a)
    SELECT user_id AS doc_id, repeat('=', 40) || chr(10) || 'ANNOTATION SUMMARY: ' || coalesce(c_name, 'Document') || chr(10) || 'Total Annotations: ' || count(*) || chr(10) || repeat('=', 40) || chr(10) || chr(10) || string_agg(note, chr(10) ORDER BY k) AS report
      FROM b LEFT JOIN customer ON c_custkey = user_id GROUP BY user_id, c_name""",
)
def _(t):
    names = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    return M.annotation_summary(annotations(t), names)
