"""Page lists: predicates, sequences, set operations, joins and counts."""

from pyspark.sql import functions as F

from corpuskit.checks import sqlparts as S
from corpuskit.checks.registry import register
from corpuskit.operators import pages as PG
from corpuskit.operators import pagesets as PS
from corpuskit.operators import predicates as PR
from corpuskit.operators import sequence as SQ
from corpuskit.operators import unique_names as UN


def dp(t):
    """Pages of two lines: doc_id, source_id, pos, page_key, rotation, n_bytes, text."""
    p = PG.paginate(t.texts.select("doc_id", F.col("source").alias("source_id"), "text"), 2)
    pos = F.col("page_no").cast("bigint")
    return p.select(
        "doc_id", "source_id", pos.alias("pos"),
        F.concat_ws("-", F.col("doc_id").cast("string"), pos.cast("string")).alias("page_key"),
        ((F.col("doc_id") + pos) % 4 * 90).alias("rotation"),
        F.octet_length("text").cast("bigint").alias("n_bytes"), "text",
    )


def keys(t):
    return dp(t).select("doc_id", "source_id", "pos", "page_key", "rotation")


def picked(t, cond="pos % 3 = 1"):
    return keys(t).filter(cond).select("doc_id", "page_key")


W = f"WITH {S.DP} "


# --- predicates -----------------------------------------------------------------------------
@register("select_pages", W + "SELECT doc_id, pos FROM dp WHERE pos IN (0, 1, 4) OR pos BETWEEN 6 AND 8")
def _(t):
    return PR.select_pages(keys(t), "2-1; 5, 9–7, x, 3-").select("doc_id", "pos")


@register(
    "select_pages_by_row",
    W + """SELECT doc_id, pos FROM dp WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1 AND pos BETWEEN 1 AND 3) OR (doc_id % 4 = 2 AND pos IN (0, 2))""",
)
def _(t):
    m = F.col("doc_id") % 4
    text = F.when(m == 0, " All ").when(m == 1, "4−2").when(m == 2, "1;3,q").otherwise("none")
    return keys(t).filter(PR.in_range_column(text, F.col("pos"))).select("doc_id", "pos")


@register("range_warnings", W + "SELECT doc_id FROM dp WHERE doc_id % 3 = 0 GROUP BY doc_id HAVING max(pos) < 4")
def _(t):
    text = F.when(F.col("doc_id") % 3 == 0, "5-7").otherwise("")
    return PR.range_warnings(keys(t).withColumn("rng", text), "rng")


@register(
    "text_presence",
    f"""WITH {S.DP}, r AS (SELECT doc_id, pos, unnest(regexp_extract_all(text, '\\S+')) AS str FROM dp WHERE pos % 5 <> 4),
    g AS (SELECT doc_id, pos, sum(length(str))::BIGINT AS c, count(*) AS k FROM r GROUP BY ALL)
    SELECT dp.doc_id, dp.pos AS page_no, coalesce(c, 0) AS char_count, coalesce(k, 0) AS run_count FROM dp LEFT JOIN g USING (doc_id, pos)""".replace("\\\\", "\\"),
)
def _(t):
    pages = dp(t).select("doc_id", F.col("pos").alias("page_no"), "text")
    runs = PG.word_runs(pages.filter("page_no % 5 <> 4"))
    return PR.text_presence(pages.select("doc_id", "page_no"), runs)


@register(
    "blank_pages",
    W + "SELECT doc_id, pos, n_bytes / 1e6 <= 0.006 AND rotation * 8 <= 900 AND length(text) <= 8 AS blank60, n_bytes / 1e6 <= 0.004 AND rotation * 8 <= 80 AND length(text) <= 0 AS blank40 FROM dp",
)
def _(t):
    ink, blob, n = F.col("n_bytes") / 1e6, F.col("rotation") * 8, F.length("text")
    return dp(t).select(
        "doc_id", "pos", PR.is_blank(ink, blob, n, 60).alias("blank60"), PR.is_blank(ink, blob, n, 40).alias("blank40")
    )


@register(
    "on_page_chars",
    f"""WITH {S.DP}, l AS (SELECT doc_id, pos, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS line_no FROM dp),
    r AS (SELECT doc_id, pos, line_no, unnest(regexp_extract_all(line, '{S.WS}*[^{S.WS[1:-1]}]+')) AS w, generate_subscripts(regexp_extract_all(line, '{S.WS}*[^{S.WS[1:-1]}]+'), 1) AS i FROM l),
    o AS (SELECT doc_id, pos, line_no, length(regexp_replace(w, '^{S.WS}+', '')) AS n, sum(length(w)) OVER (PARTITION BY doc_id, pos, line_no ORDER BY i) - length(regexp_replace(w, '^{S.WS}+', '')) AS off FROM r)
    SELECT dp.doc_id, dp.pos AS page_no, coalesce(sum(o.n) FILTER (off * 6.0 <= 600), 0)::BIGINT AS chars FROM dp LEFT JOIN o USING (doc_id, pos) GROUP BY ALL""",
)
def _(t):
    pages = dp(t).select("doc_id", F.col("pos").alias("page_no"), "text")
    runs = PG.word_runs(pages)
    ten, zero = F.lit(10.0), F.lit(0.0)
    placed = runs.select(
        "doc_id", "page_no", "str",
        F.array(ten, zero, zero, ten, F.col("off") * 6.0, 700.0 - F.col("line_no") * 14.0).alias("transform"),
        (F.length("str") * 6.0).alias("width"), F.lit(10.0).alias("height"),
    )
    box = pages.select(
        "doc_id", "page_no", F.lit(600.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("x1"), F.lit(800.0).alias("y1")
    )
    return PR.on_page_chars(placed, box)


@register(
    "never_larger",
    """SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_extendedprice < l_quantity * 1000 THEN 'result' WHEN l_returnflag = 'A' THEN 'original'
      WHEN l_extendedprice > l_quantity * 1000 THEN 'larger' ELSE 'same' END AS choice FROM lineitem""",
)
def _(t):
    c = PR.never_larger(F.col("l_quantity") * 1000, F.col("l_extendedprice"), F.col("l_returnflag") == "A")
    return t.lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint"), c.alias("choice"))


@register(
    "delete_pages",
    W + """, s AS (SELECT *, count(*) FILTER (pos % 3 = 0) OVER (PARTITION BY doc_id) = n AS refused FROM dp)
    SELECT doc_id, page_key, row_number() OVER (PARTITION BY doc_id ORDER BY s.pos) - 1 AS pos, refused AS kept_all FROM s WHERE s.pos % 3 <> 0 OR refused""",
)
def _(t):
    return SQ.delete_pages(keys(t), picked(t, "pos % 3 = 0")).select("doc_id", "page_key", "pos", "kept_all")


@register(
    "select_between",
    W + """, e AS (SELECT doc_id, min(pos) AS a, max(pos) AS b FROM dp WHERE pos IN (1, 4) GROUP BY doc_id)
    SELECT doc_id, page_key FROM dp JOIN e USING (doc_id) WHERE pos BETWEEN a AND b""",
)
def _(t):
    return SQ.select_between(keys(t), picked(t, "pos in (4, 1)")).select("doc_id", "page_key")


@register(
    "cap_per_group",
    """WITH r AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100000 + l_partkey) AS rn FROM (SELECT DISTINCT ON (l_suppkey, l_orderkey, l_partkey) * FROM lineitem)),
    m AS (SELECT l_suppkey, min(rn) AS must FROM r WHERE rn > 20 AND l_partkey % 50 = 7 GROUP BY l_suppkey)
    SELECT l_suppkey, l_orderkey, l_partkey FROM r LEFT JOIN m USING (l_suppkey) WHERE CASE WHEN must IS NULL THEN rn <= 20 ELSE rn < 20 OR rn = must END""",
)
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey").distinct()
    rows = rows.withColumn("pos", F.col("l_orderkey") * 100000 + F.col("l_partkey"))
    kept, _ = PR.cap_per_group(rows, ["l_suppkey"], "pos", 20, F.col("l_partkey") % 50 == 7)
    return kept.select("l_suppkey", "l_orderkey", "l_partkey")


@register(
    "cap_per_group_notes",
    """SELECT user_id, count(*) - 50 AS dropped FROM events GROUP BY user_id HAVING count(*) > 50""",
)
def _(t):
    return PR.cap_per_group(t.events, ["user_id"], "event_id", 50)[1]


# --- sequences ------------------------------------------------------------------------------
@register("bates_number", W + "SELECT doc_id, pos, 'KX' || lpad(CAST(row_number() OVER (ORDER BY doc_id, pos) + 99 AS VARCHAR), 6, '0') AS label FROM dp")
def _(t):
    return SQ.bates_number(keys(t), "KX", 6, 100).select("doc_id", "pos", "label")


@register("split_every", W + "SELECT doc_id, pos // 3 AS file_no, count(*) AS pages, min(pos) AS first_pos FROM dp GROUP BY ALL")
def _(t):
    return SQ.split_every(keys(t), 3).groupBy("doc_id", "file_no").agg(
        F.count(F.lit(1)).alias("pages"), F.min("pos").alias("first_pos")
    )


@register("split_custom", W + "SELECT doc_id, (pos >= 2)::BIGINT + (pos >= 5)::BIGINT + (pos >= 11)::BIGINT AS file_no, count(*) AS pages FROM dp GROUP BY ALL")
def _(t):
    cuts, _ = SQ.split_points("5, 2 11 x2 0, -3")
    return SQ.split_custom(keys(t), cuts).groupBy("doc_id", "file_no").agg(F.count(F.lit(1)).alias("pages"))


_BM = """, b AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM dp WHERE length(text) % 4 = 0),
    f AS (SELECT dp.doc_id, dp.pos, dp.text, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dp.doc_id ORDER BY dp.pos) AS BIGINT) AS file_no FROM dp LEFT JOIN b USING (doc_id, pos))"""


@register("split_bookmarks", W + _BM + " SELECT doc_id, pos, file_no FROM f")
def _(t):
    p = dp(t)
    return SQ.split_bookmarks(p, p.filter(F.length("text") % 4 == 0)).select("doc_id", "pos", "file_no")


@register(
    "compose_split",
    W + """, f AS (SELECT doc_id, pos // 2 AS file_no, arg_min(text, pos) AS title FROM dp GROUP BY ALL),
    g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_files, CASE WHEN trim(title) = '' THEN NULL ELSE trim(title) END AS tt FROM f),
    h AS (SELECT *, coalesce(tt, 'part_' || CASE WHEN file_no >= 99 THEN CAST(file_no + 1 AS VARCHAR) ELSE lpad(CAST(file_no + 1 AS VARCHAR), 2, '0') END) AS stem FROM g),
    i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(stem) ORDER BY file_no) AS k FROM h)
    SELECT doc_id, file_no, stem || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.pdf' AS file_name FROM i""",
)
def _(t):
    p = dp(t).withColumn("file_no", F.floor(F.col("pos") / 2))
    files = p.groupBy("doc_id", "file_no").agg(F.min_by("text", "pos").alias("title"))
    n = files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_files"))
    return SQ.compose_split(files.join(n, "doc_id")).select("doc_id", "file_no", "file_name")


@register(
    "reorder_pages",
    W + "SELECT doc_id, page_key, CASE WHEN doc_id % 5 = 0 OR n = 4 THEN pos ELSE n - 1 - pos END AS pos, doc_id % 5 <> 0 AND n <> 4 AS applied FROM dp",
)
def _(t):
    """Orders of every fifth document name unknown pages; those of four pages say 0, 0, 3, 3."""
    k = keys(t)
    twice = F.when(F.col("pos") < 2, 0).otherwise(3)
    order = k.join(SQ.page_counts(k), "doc_id").select(
        "doc_id", "page_key",
        F.when(F.col("doc_id") % 5 == 0, F.lit(0)).when(F.col("n") == 4, twice).otherwise(F.col("n") - 1 - F.col("pos")).alias("new_pos"),
    )
    order = order.withColumn("page_key", F.when(F.col("doc_id") % 5 == 0, "gone").otherwise(F.col("page_key")))
    return SQ.reorder_pages(k, order).select("doc_id", "page_key", "pos", "applied")


@register(
    "move_pages",
    W + """SELECT doc_id, page_key, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN pos % 3 = 1 THEN 1 WHEN pos < 4 THEN 0 ELSE 2 END, dp.pos) - 1 AS pos FROM dp""",
)
def _(t):
    return SQ.move_pages(keys(t), picked(t), 4).select("doc_id", "page_key", "pos")


@register(
    "duplicate_pages",
    W + """, c AS (SELECT doc_id, page_key, pos, 0 AS cp FROM dp UNION ALL SELECT doc_id, md5(doc_id || '|' || page_key || '|copy'), pos, 1 FROM dp WHERE pos % 3 = 1)
    SELECT doc_id, page_key, row_number() OVER (PARTITION BY doc_id ORDER BY c.pos, cp) - 1 AS pos FROM c""",
)
def _(t):
    return SQ.duplicate_pages(keys(t), picked(t)).select("doc_id", "page_key", "pos")


@register(
    "interleave_duplex",
    W + """, a AS (SELECT doc_id, page_key, pos, n, (n + 1) // 2 AS f FROM dp),
    b AS (SELECT *, CASE WHEN pos < f THEN pos ELSE n - 1 - pos END AS i, least(f, n - f) AS pairs FROM a)
    SELECT doc_id, page_key, CAST(CASE WHEN i < pairs THEN 2 * i + (pos >= f)::INT ELSE pairs * 2 + i - pairs END AS BIGINT) AS pos FROM b""",
)
def _(t):
    k = keys(t)
    return SQ.interleave_duplex(k, SQ.default_front_count(k), True).select("doc_id", "page_key", "pos")


@register(
    "duplex_fit",
    W + """, a AS (SELECT doc_id, count(*) AS n, sum((pos < 3)::INT)::BIGINT AS f FROM dp GROUP BY doc_id),
    b AS (SELECT doc_id, n, CASE WHEN n > 3 THEN f ELSE (n + 1) // 2 END AS f FROM a)
    SELECT doc_id, f AS front_count, CASE 2 * f - n WHEN 0 THEN 'exact' WHEN 1 THEN 'last-front-alone' ELSE 'mismatch' END AS fit, abs(2 * f - n) AS unpaired FROM b""",
)
def _(t):
    k = keys(t).withColumn("source_id", F.when(F.col("pos") < 3, "first").otherwise("second"))
    counts = SQ.default_front_count(k)
    return SQ.duplex_fit(counts).join(counts.select("doc_id", "front_count"), "doc_id")


@register(
    "booklet_order",
    W + """, a AS (SELECT *, CAST(ceil(n / 4) * 4 AS BIGINT) AS tot FROM dp), b AS (SELECT *, CASE WHEN pos < tot / 2 THEN pos ELSE tot - 1 - pos END AS i FROM a),
    c AS (SELECT *, 2 * i + CASE WHEN (pos < tot / 2) = (i % 2 = 0) THEN 1 ELSE 0 END AS slot FROM b)
    SELECT doc_id, pos, slot // 2 AS sheet, slot % 2 AS col, round(10.0 + (slot % 2) * 390.0, 6)::DOUBLE AS x FROM c""",
)
def _(t):
    n = SQ.nup(keys(t), "booklet", 790.0, 600.0, 10.0, 10.0)
    return n.select("doc_id", "pos", "sheet", "col", F.round("x", 6).alias("x"))


@register(
    "nup",
    W + """SELECT doc_id, pos, pos // 4 AS sheet, (pos % 4) // 2 AS "row", pos % 2 AS col, round(10 + (pos % 2) * 295, 6)::DOUBLE AS x, round(780 - ((pos % 4) // 2) * 390 - 380, 6)::DOUBLE AS y FROM dp""",
)
def _(t):
    n = SQ.nup(keys(t), "4-up", 790.0, 600.0, 10.0, 10.0)
    return n.select("doc_id", "pos", "sheet", "row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register(
    "keyboard_move_target",
    W + """, s AS (SELECT doc_id, list(pos ORDER BY pos) FILTER (pos % 4 IN (1, 2)) AS sel, count(*) AS n FROM dp GROUP BY doc_id HAVING len(sel) > 0),
    a AS (SELECT *, greatest(0, least(n - len(sel), sel[1] + 2)) AS st, sel[-1] - sel[1] + 1 = len(sel) AS cont FROM s)
    SELECT doc_id, CASE WHEN cont AND st = sel[1] THEN NULL ELSE list_min(list_filter(range(0, n + 1), lambda g: g - len(list_filter(sel, lambda x: x < g)) = st)) END AS gap FROM a""",
)
def _(t):
    k = keys(t)
    return SQ.keyboard_move_target(k.filter("pos % 4 in (1, 2)").select("doc_id", "pos"), SQ.page_counts(k), "down", 2)


@register("rotate_pages", W + "SELECT doc_id, page_key, CASE WHEN pos % 3 = 1 THEN (rotation + 270) % 360 ELSE rotation END AS rotation FROM dp")
def _(t):
    return SQ.rotate_pages(keys(t), picked(t), -90).select("doc_id", "page_key", F.col("rotation").cast("bigint"))


@register(
    "insert_pages",
    W + """, u AS (SELECT doc_id, page_key, CASE WHEN pos < 2 THEN 0 ELSE 2 END AS z, pos FROM dp UNION ALL SELECT doc_id, 'x' || page_key, 1, pos FROM dp WHERE pos < 3)
    SELECT doc_id, page_key, row_number() OVER (PARTITION BY doc_id ORDER BY z, u.pos) - 1 AS pos FROM u""",
)
def _(t):
    k = keys(t)
    extra = k.filter("pos < 3").withColumn("page_key", F.concat(F.lit("x"), "page_key"))
    return SQ.insert_pages(k, extra, 2).select("doc_id", "page_key", "pos")


@register(
    "running_labels",
    W + "SELECT doc_id, pos, 'Page ' || (pos + 7) || ' of ' || n || ' (' || (pos + 7) || ')' AS label FROM dp",
)
def _(t):
    from corpuskit.functions.names import running_label

    k = keys(t)
    label = running_label("Page {n} of {total} ({n})", F.col("pos") + 7, F.col("n"))
    return k.join(SQ.page_counts(k), "doc_id").select("doc_id", "pos", label.alias("label"))


# --- set operations -------------------------------------------------------------------------
def changed(t):
    """A later snapshot: every fifth page gone, even documents turned round, some pages turned."""
    k = keys(t)
    live = k.filter("(doc_id + pos) % 5 <> 0")
    even = F.col("doc_id") % 2 == 0
    turned = live.withColumns({
        "_o": F.when(even, 100000 - F.col("pos")).otherwise(F.col("pos")),
        "rotation": F.when(F.col("pos") % 4 == 1, (F.col("rotation") + 90) % 360).otherwise(F.col("rotation")),
    })
    moved = SQ.renumber(turned, "_o")
    new = k.filter("pos = 0").withColumns({"page_key": F.concat(F.lit("n"), "page_key"), "pos": F.lit(99999).cast("bigint")})
    return moved.unionByName(new)


CH = """, live AS (SELECT * FROM dp WHERE (doc_id + pos) % 5 <> 0),
  ch AS (SELECT doc_id, source_id, page_key, CASE WHEN live.pos % 4 = 1 THEN (rotation + 90) % 360 ELSE rotation END AS rotation,
    row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 2 = 0 THEN -live.pos ELSE live.pos END) - 1 AS pos FROM live
    UNION ALL SELECT doc_id, source_id, 'n' || page_key, rotation, 99999 FROM dp WHERE pos = 0)"""


@register(
    "align_pages",
    W + CH + """, j AS (SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, coalesce(b.page_key, c.page_key) AS page_key, b.pos AS before_pos, c.pos AS pos,
      CASE WHEN c.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'added' ELSE 'kept' END AS status, coalesce(b.rotation <> c.rotation, false) AS rotated
      FROM dp b FULL JOIN ch c ON b.doc_id = c.doc_id AND b.page_key = c.page_key)
    SELECT *, CASE WHEN status <> 'kept' OR doc_id % 2 = 1 THEN false ELSE pos <> max(pos) FILTER (status = 'kept') OVER (PARTITION BY doc_id) END AS moved FROM j""",
)
def _(t):
    """In a reversed document exactly the last page is the longest run (ties: the later one)."""
    return PS.align_pages(keys(t), changed(t)).drop("after_rotation")


@register("removed_pages", W + CH + " SELECT doc_id, page_key FROM dp EXCEPT SELECT doc_id, page_key FROM ch")
def _(t):
    return PS.removed_pages(keys(t), changed(t)).select("doc_id", "page_key")


@register("added_pages", W + CH + " SELECT doc_id, page_key FROM ch EXCEPT SELECT doc_id, page_key FROM dp")
def _(t):
    return PS.added_pages(keys(t), changed(t)).select("doc_id", "page_key")


@register("surviving_pages", W + CH + " SELECT doc_id, page_key FROM dp INTERSECT SELECT doc_id, page_key FROM ch")
def _(t):
    return PS.surviving_pages(keys(t), changed(t)).select("doc_id", "page_key")


@register(
    "merge_documents",
    W + """, u AS (SELECT page_key, 0 AS z, doc_id // 50 AS d, doc_id * 100000 + pos AS o FROM dp WHERE doc_id % 2 = 0 UNION ALL SELECT page_key, 1, doc_id // 50, doc_id * 100000 + pos FROM dp WHERE doc_id % 2 = 1)
    SELECT d AS doc_id, page_key, row_number() OVER (PARTITION BY d ORDER BY z, o) - 1 AS pos FROM u""",
)
def _(t):
    k = keys(t).withColumn("pos", F.col("doc_id") * 100000 + F.col("pos"))
    parts = [k.filter("doc_id % 2 = 0"), k.filter("doc_id % 2 = 1")]
    return PS.merge_documents(parts, F.floor(F.col("doc_id") / 50)).select("doc_id", "page_key", "pos")


@register(
    "is_dirty",
    W + CH + """ SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, bool_or(a.page_key IS DISTINCT FROM b.page_key OR a.rotation IS DISTINCT FROM b.rotation) AS dirty
      FROM dp a FULL JOIN (SELECT * FROM ch UNION ALL SELECT doc_id + 5000000, source_id, page_key, rotation, pos FROM dp) b ON a.doc_id = b.doc_id AND a.pos = b.pos GROUP BY 1""",
)
def _(t):
    k = keys(t)
    more = k.withColumn("doc_id", F.col("doc_id") + 5000000)
    return PS.is_dirty(k, changed(t).unionByName(more))


@register("revert", W + "SELECT doc_id, page_key, pos, rotation FROM dp")
def _(t):
    pages, _ = PS.revert(keys(t), changed(t))
    return pages.select("doc_id", "page_key", "pos", "rotation")


@register(
    "referenced_ids",
    "SELECT DISTINCT source AS source_id FROM documents WHERE doc_id % 3 = 0 UNION SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 1",
)
def _(t):
    d = t.documents.withColumnRenamed("source", "source_id")
    return PS.referenced_ids(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 7 = 1"))


_MARKS = """, m AS (SELECT doc_id, page_key, pos AS x, CASE WHEN pos % 2 = 0 THEN NULL ELSE 't' END AS txt FROM dp WHERE pos % 3 < 2)"""


@register(
    "merge_marks",
    W + _MARKS + """ SELECT page_key, x, txt AS text, false AS added FROM m UNION ALL
      SELECT page_key, pos, CASE WHEN pos % 2 = 0 THEN NULL ELSE 't' END, true FROM dp WHERE pos % 3 = 2""",
)
def _(t):
    text = F.when(F.col("pos") % 2 != 0, F.lit("t"))
    marks = keys(t).select("page_key", F.col("pos").alias("x"), text.alias("text"))
    return PS.merge_marks(marks.filter("x % 3 < 2"), marks.union(marks), ["page_key", "x", "text"])


# --- joins ----------------------------------------------------------------------------------
@register(
    "resolve_marks",
    W + CH + """ SELECT a.doc_id, a.page_key, CASE WHEN c.pos IS NULL THEN 'deleted' WHEN c.rotation <> a.rotation THEN 'rotated' WHEN c.pos <> a.pos THEN 'moved' ELSE 'kept' END AS state, coalesce(c.pos, a.pos) AS page_no
      FROM dp a LEFT JOIN ch c ON a.doc_id = c.doc_id AND a.page_key = c.page_key""",
)
def _(t):
    marks = keys(t).select("doc_id", "page_key", F.col("pos").alias("page_no"), F.col("rotation").alias("page_rotation"))
    return PS.resolve_marks(marks, changed(t)).select("doc_id", "page_key", "state", "page_no")


@register("referenced_sources", "SELECT DISTINCT source AS source_id FROM documents WHERE doc_id % 40 = 1")
def _(t):
    d = t.documents.withColumnRenamed("source", "source_id")
    return PS.referenced_sources(d.filter("doc_id % 40 = 1"), d.select("source_id").distinct())


@register(
    "orphan_sources",
    "SELECT DISTINCT source AS source_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 1 UNION ALL SELECT source FROM documents WHERE doc_id % 101 = 2)",
)
def _(t):
    d = t.documents.withColumnRenamed("source", "source_id")
    return PS.orphan_sources(d.select("source_id").distinct(), d.filter("doc_id % 97 = 1"), d.filter("doc_id % 101 = 2"))


@register("source_ref_counts", W + "SELECT source_id, count(*) AS pages FROM dp GROUP BY source_id")
def _(t):
    return PS.source_ref_counts(keys(t))


@register("source_doc_ref_counts", W + "SELECT source_id, count(DISTINCT doc_id) AS docs FROM dp GROUP BY source_id")
def _(t):
    return PS.source_doc_ref_counts(keys(t))


@register(
    "stamp_all_pages",
    W + "SELECT a.doc_id, b.page_key, md5(a.page_key || '|' || b.page_key) AS ann_id FROM dp a JOIN dp b ON a.doc_id = b.doc_id AND a.pos <> b.pos WHERE a.pos = 1",
)
def _(t):
    k = keys(t)
    ann = k.filter("pos = 1").select("doc_id", "page_key", F.col("page_key").alias("ann_id"))
    return PS.stamp_all_pages(ann, k).select("doc_id", "page_key", "ann_id")


@register(
    "annotation_pages",
    W + CH + " SELECT a.doc_id, a.page_key, CASE WHEN a.pos % 3 = 0 THEN a.pos ELSE c.pos END AS page_no FROM dp a LEFT JOIN ch c USING (doc_id, page_key)",
)
def _(t):
    ann = keys(t).select("doc_id", "page_key", F.when(F.col("pos") % 3 == 0, F.col("pos")).alias("page_index"))
    return PS.annotation_pages(ann, changed(t)).select("doc_id", "page_key", "page_no")


@register(
    "place_highlights",
    W + """SELECT doc_id, page_key, round(CASE WHEN rotation = 0 THEN greatest(n_bytes / 100000, 0.001) ELSE greatest(n_bytes / 100000 * rotation / 90, 0.001) END, 6) AS stroke_width,
      round(0.1 + n_bytes / 200000, 6) AS mid FROM dp""",
)
def _(t):
    p = dp(t)
    regions = p.select(
        "doc_id", F.col("pos").alias("page_no"), F.lit(0.2).alias("x"), F.lit(0.1).alias("y"),
        F.lit(0.3).alias("width"), (F.col("n_bytes") / 100000).alias("height"),
    )
    pages = p.select("doc_id", "pos", "page_key", (F.col("rotation") / 90.0).alias("aspect"))
    placed, _ = PS.place_highlights(regions, pages)
    return placed.select(
        "doc_id", "page_key", F.round("stroke_width", 6).alias("stroke_width"), F.round(F.col("points")[0]["y"], 6).alias("mid")
    )


@register("unplaced_highlights", W + CH + " SELECT doc_id, count(*) AS unplaced FROM dp a WHERE NOT EXISTS (SELECT 1 FROM ch c WHERE c.doc_id = a.doc_id AND c.pos = a.pos) GROUP BY doc_id")
def _(t):
    regions = keys(t).select(
        "doc_id", F.col("pos").alias("page_no"), F.lit(0.2).alias("x"), F.lit(0.1).alias("y"), F.lit(0.3).alias("width"), F.lit(0.1).alias("height")
    )
    return PS.place_highlights(regions, changed(t).withColumn("aspect", F.lit(1.0)))[1]


def bookmarks(t):
    """A bookmark per page: every third is top level, the others below the one before."""
    p = dp(t)
    third = (F.floor(F.col("pos") / 3)).cast("int")
    path = F.when(F.col("pos") % 3 == 0, F.array(third)).otherwise(F.array(third, (F.col("pos") % 3 - 1).cast("int")))
    title = F.when(F.col("pos") % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.regexp_replace("text", r"\W", "")))
    return p.select("doc_id", F.col("pos").alias("node_no"), path.alias("path"), title.alias("title"), "page_key")


_T = "CASE WHEN a.pos % 7 = 3 OR regexp_replace(a.text, '[^0-9A-Za-z_]', '', 'g') = '' THEN 'Untitled' ELSE regexp_replace(a.text, '[^0-9A-Za-z_]', '', 'g') END"


@register(
    "resolve_outline",
    W + CH + f" SELECT a.doc_id, a.pos AS node_no, {_T} AS title, coalesce(c.pos, -1) AS page_no FROM dp a LEFT JOIN ch c USING (doc_id, page_key)",
)
def _(t):
    return PS.resolve_outline(bookmarks(t), changed(t)).select("doc_id", "node_no", "title", "page_no")


@register(
    "bookmark_slices",
    W + CH + f" SELECT a.doc_id, c.pos AS page_no, {_T} AS title FROM dp a JOIN ch c USING (doc_id, page_key) WHERE a.pos % 3 = 0",
)
def _(t):
    r = PS.resolve_outline(bookmarks(t), changed(t)).withColumn("depth", F.size("path") - 1)
    return PS.bookmark_slices(r)


@register(
    "flatten_outline",
    W + """SELECT doc_id, pos AS node_no, CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS depth, CASE WHEN pos % 3 = 0 THEN pos > 0 ELSE pos % 3 = 2 END AS up,
      CASE WHEN pos % 3 = 0 THEN pos + 3 < n ELSE pos % 3 = 1 AND pos + 1 < n END AS down, pos % 3 <> 0 AS outdent FROM dp""",
)
def _(t):
    return PS.flatten_outline(bookmarks(t)).select("doc_id", "node_no", "depth", "up", "down", "outdent")


@register(
    "edit_outline",
    W + """SELECT doc_id, pos AS node_no, CASE WHEN n < 4 THEN CASE WHEN pos % 3 = 0 THEN '' || pos // 3 ELSE (pos // 3) || '.' || (pos % 3 - 1) END
      WHEN pos = 3 THEN '0.' || 2 WHEN pos IN (4, 5) THEN '0.2.' || (pos - 4) WHEN pos % 3 = 0 THEN '' || pos // 3 ELSE (pos // 3) || '.' || (pos % 3 - 1) END AS path FROM dp""",
)
def _(t):
    """Indent the second top-level bookmark: it goes under the first, after its two children."""
    e = PS.edit_outline(bookmarks(t), "indent", 3)
    return e.select("doc_id", "node_no", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


# --- names ----------------------------------------------------------------------------------
@register(
    "unique_names",
    """SELECT p_partkey, p_name || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END AS uniq FROM
      (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""",
)
def _(t):
    return UN.unique_names(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey", "uniq").select("p_partkey", "uniq")


@register("unique_names_colliding")
def _(t):
    """Real names that look made up, mixed in; checked against a sequential run in the tests."""
    name = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" ("), (F.col("p_size") % 9 + 1).cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    return UN.unique_names(t.part.select("p_partkey", name.alias("name")), "name", "p_partkey", "uniq")


@register(
    "batch_names",
    """WITH a AS (SELECT c_custkey, 'Segment ' || lower(c_mktsegment) || '-2024-05-06' AS name FROM customer),
    b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS k FROM a)
    SELECT c_custkey, name || CASE WHEN k = 1 THEN '' ELSE ' (' || k || ')' END AS out_name FROM b""",
)
def _(t):
    from corpuskit.plans.recipe import batch_names

    files = t.customer.select(
        F.col("c_custkey").alias("pos"), F.concat(F.lit("Segment "), F.lower("c_mktsegment"), F.lit(".pdf")).alias("name")
    )
    return batch_names(files, "{basename}-{date}", "2024-05-06").select(F.col("pos").alias("c_custkey"), "out_name")


@register(
    "free_names",
    """WITH w AS (SELECT c_custkey AS pos, c_nationkey AS folder, st || '.pdf' AS name, st FROM (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'building (2)' ELSE lower(c_mktsegment) END AS st FROM customer)),
    e AS (SELECT DISTINCT s_nationkey AS folder, s_suppkey % 4 AS n FROM supplier),
    k AS (SELECT *, row_number() OVER (PARTITION BY folder, st ORDER BY pos) AS k FROM w),
    f AS (SELECT folder, st, list_filter(range(0, 2000), lambda i: NOT list_contains(coalesce(ns, []), i)) AS free FROM
      (SELECT folder, st, CASE WHEN g.st = 'building' THEN (SELECT list(2) FROM w WHERE w.folder = g.folder AND w.st = 'building (2)') ELSE (SELECT list(n) FROM e WHERE e.folder = g.folder AND g.st = 'machinery') END AS ns FROM (SELECT DISTINCT folder, st FROM w) g))
    SELECT pos, CASE WHEN free[k] = 0 THEN name ELSE st || ' (' || free[k] || ').pdf' END AS free_name FROM k JOIN f USING (folder, st)""",
)
def _(t):
    wanted = t.customer.select(
        F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("folder"),
        F.when(F.col("c_custkey") % 11 == 0, "building (2).pdf").otherwise(
            F.concat(F.lower("c_mktsegment"), F.lit(".pdf"))
        ).alias("name"),
    )
    n = F.col("s_suppkey") % 4
    have = t.supplier.select(
        F.col("s_nationkey").alias("folder"),
        F.when(n == 0, "MACHINERY.pdf").otherwise(F.concat(F.lit("Machinery ("), n.cast("string"), F.lit(").PDF"))).alias("name"),
    )
    return UN.free_names(wanted, have).select("pos", "free_name")


@register(
    "rename_fields",
    """WITH f AS (SELECT DISTINCT user_id AS src, event_type AS name FROM events),
    k AS (SELECT src, name, row_number() OVER (PARTITION BY name ORDER BY src) AS k FROM f)
    SELECT src, name, name || CASE WHEN k = 1 THEN '' ELSE '_' || k END AS new_name FROM k""",
)
def _(t):
    from corpuskit.operators.metadata import rename_fields

    fields = t.events.select(F.col("user_id").alias("src"), F.col("event_type").alias("name"))
    return rename_fields(fields, "src", "name").select("src", "name", "new_name")
